"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

Groups are summed before anything else. Each task runs the differencing over the
groups it holds: the two partial partitions with the largest spread are combined
in opposite order until one is left. The partial partitions of all tasks (as
many numbers as tasks times shards) are then combined in the same way, and each
task's local shards are renamed to the final ones.

Edge cases: a null text has no bytes and counts as an empty one, in the same
group; sizes are bytes plus one, so none is zero; a group larger than a fair
share stays whole; repeated rows belong to their group and get slots of their
own; ties are broken by hash; an empty table gives no rows. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import written

SHARDS = 8
_SLOT_PARTS = 256


def difference(parts: list[list[int]], k: int) -> np.ndarray:
    """For each partial partition (k sums), the final shard of each of its k positions."""
    n = len(parts)
    if not n:
        return np.zeros((0, k), np.int16)
    sums: list[tuple[int, ...]] = []
    leaf_order, heap = [], []
    for i, part in enumerate(parts):
        order = sorted(range(k), key=lambda j: (-part[j], j))
        s = tuple(part[j] for j in order)
        leaf_order.append(order)
        sums.append(s)
        heap.append((s[-1] - s[0], i))
    heapq.heapify(heap)
    joins: list[tuple[int, int, list[int]]] = []
    ranks = range(k)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        low = sums[b]
        s = [x + low[k - 1 - j] for j, x in enumerate(sums[a])]
        sums[a] = sums[b] = ()
        order = sorted(ranks, key=lambda j: (-s[j], j))
        s = tuple(s[j] for j in order)
        sums.append(s)
        joins.append((a, b, order))
        heapq.heappush(heap, (s[-1] - s[0], n + len(joins) - 1))
    place = np.zeros((n + len(joins), k), np.int16)
    place[-1] = np.arange(k)
    for at in range(len(joins) - 1, -1, -1):
        a, b, order = joins[at]
        mine = np.empty(k, np.int16)
        mine[order] = place[n + at]
        place[a], place[b] = mine, mine[::-1]
    out = np.empty((n, k), np.int16)
    for i, order in enumerate(leaf_order):
        out[i, order] = place[i]
    return out


def _local(k: int, most: int = 20_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        rows = rows.sort_by([(c, "ascending") for c in ("bytes", "h", "text_crc32", "size")])
        # runs of groups, each differenced on its own, then the runs' partial partitions
        bytes_, places, partials = rows["bytes"].to_numpy(), [], []
        n = -(-len(bytes_) // most)
        part = np.empty(len(bytes_), np.int32)
        for i in range(n):  # every n-th group, so that large and small ones meet in each run
            own = difference([[x] + [0] * (k - 1) for x in bytes_[i::n].tolist()], k)[:, 0]
            places.append(own)
            sums = [0] * k
            for j in range(k):
                sums[j] = int(bytes_[i::n][own == j].sum())
            partials.append(sums)
        renamed = difference(partials, k)
        for i, own in enumerate(places):
            part[i::n] = renamed[i][own]
        task = TaskContext.get().partitionId()
        out = rows.append_column("task", pa.array(np.full(len(part), task, np.int32))).append_column("part", pa.array(part))
        yield from out.to_batches()

    return run


def sharded(docs: DataFrame, k: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard (0 to k-1), slot (gapless within its shard), grown_shard (null)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")))
    key = ["h", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg(F.sum("size").alias("bytes"))
    local = written(groups.mapInArrow(_local(k), "h long, text_crc32 long, size long, bytes long, task int, part int"))
    sums = local.groupBy("task", "part").agg(F.sum("bytes").alias("bytes")).collect()  # tasks times shards
    tasks = sorted({r["task"] for r in sums})
    each = {t: [0] * k for t in tasks}
    for r in sums:
        each[r["task"]][r["part"]] = int(r["bytes"])
    final = difference([each[t] for t in tasks], k)
    names = spark.createDataFrame([(t, j, int(final[i, j])) for i, t in enumerate(tasks) for j in range(k)], "task int, part int, shard int")
    placed = local.join(F.broadcast(names), ["task", "part"]).select(*key, "shard")
    out = written(rows.join(placed, key).select("doc_id", "size", "text_crc32", "h", "shard", F.pmod(F.xxhash64("doc_id", "h"), F.lit(_SLOT_PARTS)).cast("int").alias("bin")))
    bins = out.groupBy("shard", "bin").agg(F.count("*").alias("c"))
    start = bins.select("shard", "bin", (F.sum("c").over(Window.partitionBy("shard").orderBy("bin")) - F.col("c")).alias("start"))  # shards times bins
    slot = F.col("start") + F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "h")) - 1
    return out.join(F.broadcast(start), ["shard", "bin"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
