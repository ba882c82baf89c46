"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length within their source. A source's
target gives whole rounds over all its documents and a remaining budget below
one round. The budget is first spread in proportion over the lengths, and what
that leaves is fitted by a bounded knapsack over the lengths still available.
The result is a number of documents for each length; which ones they are is
decided by a seeded hash.

Edge cases: null and empty texts have size 0 and get the whole rounds only; a
null source is a source of its own, last in order; a source without words has
target 0; repeated rows are documents of their own; ties in the hash are broken
by doc_id, and rows equal in both are interchangeable; an empty table gives no
rows. Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import long_rows, written

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_ROUNDS = 2
SEED = 20_240_601
_PARTS = 512


def n_words(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: dict, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_ROUNDS) -> dict:
    """Target of each source (key: name or None): share of all sizes by weight, at most `most` times its size, the excess dealt anew."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, list(order), share * sum(sizes.values())
    while free:
        per = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * per > most * sizes[s]]
        if not full:
            return out | {s: weight[s] * per for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = 1 << 16) -> np.ndarray:
    """How many documents of each length to take, at most counts, for a sum as near the budget as the window's knapsack finds, or one document longer than the window in place of others."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for most in (1, None):
        for i in order:
            if left <= window:
                break
            n = min(int(counts[i] - take[i]), (left - 1) // int(lengths[i]) if lengths[i] else 0, most or left)
            take[i] += n
            left -= n * int(lengths[i])
    # bounded knapsack over what is left, as a set of reachable sums up to one document beyond; by[s] is the item that first reached s
    spare = [i for i in range(len(lengths)) if lengths[i] > 0 and counts[i] > take[i]]
    top = left + min(max((int(lengths[i]) for i in spare), default=0), window)
    reach, by, items, full = 1, np.full(top + 1, -1, np.int64), [], (1 << (top + 1)) - 1
    for i in sorted(spare, key=lambda i: (int(lengths[i]) * 2_654_435_761) % (1 << 32)):
        n, step = min(int(counts[i] - take[i]), top // int(lengths[i])), 1
        while n and not reach >> left & 1:
            k = min(step, n)
            new = (reach << (k * int(lengths[i]))) & full & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits)] = len(items)
                items.append((i, k))
                reach |= new
            n, step = n - k, 2 * step
    at = next(s for d in range(top + 1) for s in (left - d, left + d) if 0 <= s <= top and reach >> s & 1)
    if left > window and spare:
        # each spare document is longer than what is left: the shortest one, in place of taken ones as far as they fit into its excess
        i = min(spare, key=lambda i: int(lengths[i]))
        other, over = take.copy(), int(lengths[i]) - left
        other[i] += 1
        for j in order:
            n = min(int(other[j]), over // int(lengths[j])) if over > 0 and lengths[j] else 0
            other[j] -= n
            over -= n * int(lengths[j])
        if abs(over) < abs(at - left):
            return other
    while at:
        i, k = items[by[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_ROUNDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times the mix takes the document), taken (copies * size)."""
    spark = docs.sparkSession
    rows = written(docs.select("doc_id", "source", n_words("text").alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("draw"), F.xxhash64("text").alias("tie")))
    per_length = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sums = {r["source"]: int(r["s"]) for r in per_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()}
    want = targets(sums, weights, share, most)
    plan = [(s, sums[s], float(t), min(most, int(t // sums[s])) if sums[s] else 1, int(t)) for s, t in want.items()]
    facts = spark.createDataFrame(plan, "source string, source_size long, target double, rounds int, whole long")  # one row a source, made on the driver: the side to broadcast

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        head = part.iloc[0]
        lengths, counts = part["size"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
        budget = int(head["whole"]) - int(head["rounds"]) * int(head["source_size"])
        more = fit(lengths, counts, budget) if head["rounds"] < most and budget > 0 else np.zeros(len(part), np.int64)
        return part[["source", "size", "n", "source_size", "target", "rounds"]].assign(more=more)

    joined = per_length.join(F.broadcast(facts), per_length["source"].eqNullSafe(facts["source"])).select(per_length["source"], "size", "n", "source_size", "target", "rounds", "whole")
    wanted = written(joined.groupBy("source").applyInPandas(fitted, "source string, size long, n long, source_size long, target double, rounds int, more long"))

    # the first `more` of a length in the order of the draw: by parts of the draw's range, so that a large group of one length is split
    part = F.pmod("draw", F.lit(_PARTS)).cast("int")
    some = rows.withColumn("part", part)
    nth = some.withColumn("nth", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("draw", "doc_id", "tie")))
    counts = some.groupBy("source", "size", "part").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("c")).drop("c")
    w = wanted.alias("w")
    bounds = before.alias("b").join(w.hint("merge"), F.col("b.source").eqNullSafe(F.col("w.source")) & (F.col("b.size") == F.col("w.size"))).select("b.source", "b.size", "b.part", "before", "source_size", "target", "rounds", "more").alias("p")
    on = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")) & (F.col("d.part") == F.col("p.part"))
    copies = F.col("rounds") + (F.col("before") + F.col("nth") <= F.col("more")).cast("int")
    return nth.alias("d").join(bounds, on).select("d.doc_id", "d.source", "d.size", "source_size", "target", copies.alias("copies"), (copies * F.col("d.size")).cast("long").alias("taken"), F.col("d.draw").alias("draw"), F.col("d.tie").alias("tie"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, columns of docs: each document as many times as the mix takes it."""
    keys = ["__m_id", "__m_tie", "__m_source"]

    def key(tie: Column) -> list[Column]:
        return [F.coalesce("doc_id", F.lit(-(1 << 63))).alias(keys[0]), tie.alias(keys[1]), F.xxhash64("source", F.col("source").isNull()).alias(keys[2])]

    cut = mixed(docs, **options).select(*key(F.col("tie")), "copies").groupBy(*keys).agg(F.sum("copies").alias("__m_copies"), F.count("*").alias("__m_rows"))
    out = docs.select("*", *key(F.xxhash64("text"))).join(cut, keys)
    # rows equal in id, text and source share their copies: each gets the whole part, the first ones one more
    out = out.withColumn("__m_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(keys[0])))
    whole = F.floor(F.col("__m_copies") / F.col("__m_rows"))
    times = whole + (F.col("__m_nth") <= F.col("__m_copies") - whole * F.col("__m_rows")).cast("long")
    return out.withColumn("__m_copy", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*docs.columns)
