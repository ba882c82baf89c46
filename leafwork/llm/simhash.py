"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. The binary
Golay code (23, 12) is perfect: every word lies within 3 bits of one codeword. A
segment is decoded together with all words one bit away, which gives one to six
codeword indices; two segments that differ in at most one bit have, in either
direction, the plain index of one among the indices of the other. With 3 errors
in 3 segments at least two segments hold at most one error each, so for each
pair of segments a fingerprint has the keys (near index, plain index) and
(plain index, near index), and two linked fingerprints share a key of some pair.
Fingerprints that share a key are verified bit by bit. The pipeline's stage takes
the pairs that share a key as candidates only, and compares their five-word shingles.

Edge cases: null and empty texts have fingerprint zero and are linked like any
other; equal fingerprints are one node, so copies are never expanded into pairs;
repeated rows each have a row in the result; an empty table gives no rows; a
group without any doc_id has component_id null. No other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import discard, long_rows, written

SEGMENTS = ((0, 22), (22, 21), (43, 21))
_CHUNK = 1 << 16
#: Nodes a task remembers the trees of.
_NODES = 1 << 20
#: Edges that one task contracts at once (32 MB).
EDGES_A_TASK = 1 << 21
#: Fingerprints a document that the stage takes keys from.
FINGERPRINTS = 4
#: Bits in which a candidate's fingerprints that share a key may differ, when shingle sets are compared afterwards.
CANDIDATE_BITS = 14
#: Near copies of the stage: Jaccard similarity over shingles of so many words.
LEAST_SIMILARITY = 0.8
SHINGLE = 5
#: Members of a run that are held against each other at once, if that gives no more than PAIRS_A_MEMBER pairs each.
RUN = 64
PAIRS_A_MEMBER = 4
#: Classes of the counts that pairs between components are held against before they are joined.
WIDE = 256
#: Pairs of a member with other components that the first round takes; each further round takes that many times more.
ROUND = 64
_RUNS = "runs array<struct<key: int, fp: long>>"


def fingerprints_of(text: str | None, n: int = 1, width: int = 3) -> bytes:
    """n fingerprints of eight bytes, highest bit first: bits set in over half the hashes of the word shingles.

    The first one takes the shingles' XXH64 (seed 42); the others take it mixed anew.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8 * n)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    digest, votes = xxhash.xxh64_digest, np.zeros((n, 64), np.int64)
    for at in range(0, len(shingles), _CHUNK):
        h = np.frombuffer(b"".join([digest(s, 42) for s in shingles[at : at + _CHUNK]]), ">u8").astype(np.uint64)
        for k in range(n):
            if k:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            votes[k] += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * votes > len(shingles), axis=1).tobytes()


def fingerprint(text: str | None, width: int = 3) -> bytes:
    return fingerprints_of(text, 1, width)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = b"".join([fingerprint(t.as_py()) for t in batch.column(1)])
        yield pa.record_batch([batch.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], names=["doc_id", "fp"])


# -- the Golay code ---------------------------------------------------------

_GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of each byte at its three places, and the error pattern of each syndrome."""
    one = [_remainder(1 << i) for i in range(23)]
    syndromes = np.zeros((3, 256), np.uint32)
    for place in range(3):
        for byte in range(256):
            for bit in range(8):
                if byte >> bit & 1 and 8 * place + bit < 23:
                    syndromes[place, byte] ^= one[8 * place + bit]
    errors = np.zeros(2048, np.uint32)
    for k in (1, 2, 3):
        for bits in combinations(range(23), k):
            s = 0
            for b in bits:
                s ^= one[b]
            errors[s] = sum(1 << b for b in bits)
    return syndromes, errors


_SYNDROMES, _ERRORS = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    w = words.astype(np.uint32)
    s = _SYNDROMES[0][w & 255] ^ _SYNDROMES[1][w >> 8 & 255] ^ _SYNDROMES[2][w >> 16]
    return (w ^ _ERRORS[s]) >> 11


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (row, key) of unsigned fingerprints; a key holds the pair of segments and two codeword indices."""
    plain, near = [], []
    for shift, bits in SEGMENTS:
        seg = (fps >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)
        flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
        all_near = np.sort(decode(seg[:, None] ^ flips[None, :]), axis=1)
        fresh = np.ones(all_near.shape, bool)
        fresh[:, 1:] = all_near[:, 1:] != all_near[:, :-1]
        plain.append(decode(seg).astype(np.int64))
        near.append((all_near.astype(np.int64), fresh))
    rows, keys = [], []
    for pair, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        head = pair << 24
        at, col = np.nonzero(near[i][1])
        rows.append(at)
        keys.append(head | near[i][0][at, col] << 12 | plain[j][at])
        at, col = np.nonzero(near[j][1] & (near[j][0] != plain[j][:, None]))
        rows.append(at)
        keys.append(head | plain[i][at] << 12 | near[j][0][at, col])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        if len(fps):
            rows, keys = keys_of(fps.view(np.uint64))
            yield pa.record_batch([pa.array(keys.astype(np.int32)), pa.array(fps[rows])], names=["k", "fp"])


def link_run(fps: np.ndarray, most: int) -> list[tuple[np.uint64, np.uint64]]:
    """Star edges that connect what is connected within `most` bits: each fingerprint is expanded once, against those not yet reached."""
    rest, edges = np.sort(fps), []
    while len(rest) > 1:
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            hit = np.bitwise_count(rest ^ queue.pop()) <= most
            if hit.any():
                found = rest[hit]
                edges += [(root, x) for x in found]
                queue += list(found)
                rest = rest[~hit]
    return edges


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) for every node of the edges (a, b) but the roots; a root is the least node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    own = np.arange(len(nodes))
    return nodes[label[label != own]], nodes[own[label != own]]


class _Trees:
    """Edges of one task, contracted whenever many have come together: what goes out are tree edges, one for each node but the roots."""

    def __init__(self, most: int = EDGES_A_TASK):
        self.parts, self.n, self.most = [], 0, most

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((a, b))
        self.n += len(a)
        if self.n > self.most:
            a, b = self._contracted()
            if len(a) > self.most // 2:  # bounded memory: these go out, later ones start anew
                yield self._batch(a, b)
            else:
                self.parts, self.n = [(a, b)], len(a)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield self._batch(*self._contracted())

    def _contracted(self):
        out = forest(np.concatenate([a for a, _ in self.parts]), np.concatenate([b for _, b in self.parts]))
        self.parts, self.n = [], 0
        return out

    @staticmethod
    def _batch(a, b):
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tree edges of a task's edges."""
    trees = _Trees()
    for batch in batches:
        yield from trees.add(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
    yield from trees.rest()


def _linker(most: int, small: int = 24):
    """Of the keyed fingerprints of a task, in order of their key, the tree edges of what is verified within a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_k, tail_f, trees = np.zeros(0, np.int32), np.zeros(0, np.uint64), _Trees()

        def links(k, f):
            """Verified pairs: of short runs at each lag, of long ones by growing from a root. They stay in the task."""
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.concatenate([edge, [len(k)]]))
            left, right = [f[:0]], [f[:0]]
            for lo, n in zip(edge[size > small], size[size > small]):
                pairs = link_run(f[lo : lo + n], most)
                left.append(np.array([a for a, _ in pairs], np.uint64))
                right.append(np.array([b for _, b in pairs], np.uint64))
            short = np.repeat(size <= small, size)
            for lag in range(1, min(small, int(size.max()))):
                i = np.flatnonzero((k[lag:] == k[:-lag]) & short[lag:])
                i = i[np.bitwise_count(f[i] ^ f[i + lag]) <= most]
                left.append(f[i])
                right.append(f[i + lag])
            return trees.add(np.concatenate(left), np.concatenate(right))

        for batch in batches:
            k = np.concatenate([tail_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([tail_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1], "left"))
            tail_k, tail_f = k[cut:], f[cut:]
            if cut:
                yield from links(k[:cut], f[:cut])
        if len(tail_k):
            yield from links(tail_k, tail_f)
        yield from trees.rest()

    return run


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect everything connected within `most` bits.

    The keys hold for at most 3 bits. Each task returns tree edges only: of a group of n at most n - 1, and of all
    tasks at most one for each of a fingerprint's keys.
    """
    if not 0 <= most <= 3:
        raise ValueError("the segments find differences of 3 bits at most")
    keyed = fps.select("fp").mapInArrow(_keyed, "k int, fp long")
    runs = keyed.repartition("k").sortWithinPartitions("k", "fp")
    return runs.mapInArrow(_linker(most), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): alternating large and small stars, each round written to the shared folder.

    First the edges are dealt by their larger end and contracted in each task, then again in tasks of about
    EDGES_A_TASK: what is left is about one for each node. The table of a round is deleted when the next one is written.
    """
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    dealt = written(ordered.repartition("b").mapInArrow(_contract, "a long, b long").distinct())
    tasks = 1 + dealt.count() // EDGES_A_TASK
    e = written(dealt.coalesce(tasks).mapInArrow(_contract, "a long, b long").distinct())
    discard(dealt)
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        down = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(down, large["b"] == down["u"]).select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("x")).select("x.a", "x.b")
        old, e = e, written(small.where("a <> b").distinct())
        discard(old)
        now = mark(e)
        if now == before:
            break
        before = now
    out = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    out._leafwork_path = e._leafwork_path
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), written once."""
    long_rows(docs.sparkSession)
    return written(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long"))


def near_duplicates(docs: DataFrame, most: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id reachable)."""
    rows = fingerprinted(docs)
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    nodes = components(links(fps, most))
    rooted = fps.join(nodes, fps["fp"] == nodes["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = written(rooted.join(least, "root").select("fp", "component_id"))
    discard(fps)
    discard(nodes)
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- the stage: similarity of five-word shingles -----------------------------


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted 32-bit hashes of the distinct shingles; a text of fewer words has one shingle, a text without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint32)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(x, 42) for x in shingles), np.uint32))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _node(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())) - (1 << 63)


def _noded(n: int):
    names = ["doc_id", "th", "node", "classes", *(f"fp{k}" for k in range(n))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            fps = np.frombuffer(b"".join([fingerprints_of(t, n) for t in texts]), ">i8").astype(np.int64).reshape(-1, n)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([_node(t) for t in texts], pa.int64()), pa.array([classes_of(shingle_set(t)) for t in texts], pa.int64()), *(pa.array(fps[:, k].copy()) for k in range(n))], names=names)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each node, once a task (or once for each _NODES of them), so that a large group of copies is no hot key."""
    seen: set[int] = set()
    for batch in batches:
        nodes, sets = [], []
        for text in batch.column(0).to_pylist():
            node = _node(text)
            if node in seen:
                continue
            if len(seen) >= _NODES:
                seen.clear()
            seen.add(node)
            nodes.append(node)
            sets.append(shingle_set(text).tobytes())
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _keyed_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each (k, fp, head, classes), with k above the 26 bits of a key."""
    for batch in batches:
        k, fps, heads, classes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        for at in range(0, len(fps), 4096):
            rows, keys = keys_of(fps[at : at + 4096].view(np.uint64))
            keys = (keys | k[at : at + 4096][rows].astype(np.int64) << 26).astype(np.int32)
            yield pa.record_batch([pa.array(keys), pa.array(fps[at : at + 4096][rows]), pa.array(heads[at : at + 4096][rows]), pa.array(classes[at : at + 4096][rows])], names=["key", "fp", "node", "classes"])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def run_pairs(f: np.ndarray, classes: np.ndarray, most: int, least: float, small: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in a run, given in order of hubs, whose fingerprints lie within `most` bits and whose classes allow a similarity of `least`.

    All of a short run; of a long one those with a root each, so that a large group gives no square of pairs. What
    its classes tell apart from a root stays, to be held against the next ones. The other pairs of a long run are
    left to `pairs_across`, once it is known which members these pairs link.
    """
    left, right, at = [], [], np.arange(len(f))
    while len(at) > 1:
        near = np.bitwise_count(f[at[1:]] ^ f[at[0]]) <= most
        if near.any():
            one = classes[at[:1]]
            near[near] = most_similar(one, classes[at[1:][near]]) >= least
        left.append(np.full(int(near.sum()), at[0]))
        right.append(at[1:][near])
        at = at[1:] if len(at) <= small else at[1:][~near]
    return np.concatenate(left or [at[:0]]), np.concatenate(right or [at[:0]])


def pairs_across(f: np.ndarray, classes: np.ndarray, wide: np.ndarray, roots: np.ndarray, most: int, least: float, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places in a run between members of different components that run_pairs would take, and whose wide classes allow `least` as well.

    Of a member outside the run's largest component the first `each` pairs; third: whether it has more, at its last one.
    """
    names, own, size = np.unique(roots, return_inverse=True, return_counts=True)
    left, right, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    outside = own != size.argmax()
    for i in np.flatnonzero(outside):
        at = np.flatnonzero((own != own[i]) & (np.bitwise_count(f ^ f[i]) <= most))
        at = at[(at > i) | ~outside[at]]  # a pair outside once
        at = at[most_similar(classes[i : i + 1], classes[at]) >= least]
        fit, n = [at[:0]], 0
        for lo in range(0, len(at), 4096):
            some = at[lo : lo + 4096]
            fit.append(some[most_similar_wide(wide[i], wide[some]) >= least])
            if (n := n + len(fit[-1])) > each:
                break
        fit = np.concatenate(fit)[:each]
        left.append(np.full(len(fit), i))
        right.append(fit)
        more.append((np.arange(len(fit)) == each - 1) & (n > each))
    return np.concatenate(left), np.concatenate(right), np.concatenate(more)


def wide_classes_of(shingles: np.ndarray) -> np.ndarray:
    """How many of a set's hashes lie in each of WIDE classes, a byte each; all 255 where a byte does not hold them."""
    counts = np.bincount(shingles & (WIDE - 1), minlength=WIDE)
    return np.full(WIDE, 255, np.uint8) if counts.max() > 254 else counts.astype(np.uint8)


def most_similar_wide(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The greatest similarity that a set with the wide classes x can have with those of each row of y."""
    both, all_ = np.minimum(x, y).sum(1, dtype=np.int64), np.maximum(x, y).sum(1, dtype=np.int64)
    return np.where((x[0] == 255) | (y[:, 0] == 255) | (all_ == 0), 1.0, both / np.maximum(all_, 1))


def classes_of(shingles: np.ndarray) -> int:
    """How many of a set's hashes lie in each of eight classes, a byte each; -1 where a byte does not hold them."""
    counts = np.bincount(shingles & 7, minlength=8)
    return -1 if counts.max() > 254 else int(counts.astype(np.uint8).view(np.int64)[0])


def most_similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The greatest similarity that sets with these classes can have: a class shares at most the lesser of its counts."""
    x, y = (c.view(np.uint8).reshape(-1, 8).astype(np.int64) for c in (a, b))
    both, all_ = np.minimum(x, y).sum(1), np.maximum(x, y).sum(1)
    return np.where((a == -1) | (b == -1) | (all_ == 0), 1.0, both / np.maximum(all_, 1))


def _pairs(most: int, least: float):
    """Candidates (a, b) of a task's runs: near enough, and not too different in their classes to be as similar as `least`.

    A run whose candidates are not all of its pairs that are so follows whole, as rows (key, fp, a: node, classes).
    """
    names = ["key", "fp", "a", "b", "classes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int32, np.uint64, np.int64, np.int64)
        tail, found, left, n = [np.zeros(0, t) for t in kinds], [], [], 0

        def pairs(k, f, node, classes):
            order = np.lexsort((_mixed(node.view(np.uint64)), k))  # the same hubs in all runs of all fingerprints
            k, f, node, classes = (np.ascontiguousarray(x[order]) for x in (k, f, node, classes))
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.concatenate([edge, [len(k)]]))
            two = edge[size == 2]
            two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= most]
            got = [(two, two + 1)]
            for lo, m in zip(edge[size > 2].tolist(), size[size > 2].tolist()):
                one = slice(lo, lo + m)
                x, y = run_pairs(f[one], classes[one], most, least, small=m if m <= RUN else 8)
                if m > 8 and (m > RUN and len(x) or len(x) > PAIRS_A_MEMBER * m):
                    x, y = run_pairs(f[one], classes[one], most, least)
                    left.append((k[one], f[one], node[one], classes[one]))
                got.append((x + lo, y + lo))
            a, b = (np.concatenate(x) for x in zip(*got))
            fit = (most_similar(classes[a], classes[b]) >= least) & (node[a] != node[b])
            a, b = node[a[fit]], node[b[fit]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            return len(a) + sum(len(x[0]) for x in left)

        def distinct():
            rows = np.unique(np.concatenate(found), axis=0)
            found.clear()
            none = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.int64(), pa.int64())]
            yield pa.record_batch([none[0], none[1], *(pa.array(rows[:, i].copy()) for i in range(2)), none[2]], names=names)
            if left:
                k, f, node, classes = (np.concatenate(x) for x in zip(*left))
                left.clear()
                yield pa.record_batch([pa.array(k), pa.array(f.view(np.int64)), pa.array(node), pa.nulls(len(k), pa.int64()), pa.array(classes)], names=names)

        for batch in batches:
            now = [np.concatenate([t, batch.column(i).to_numpy(zero_copy_only=False).view(t.dtype)]) for i, t in enumerate(tail)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1], "left"))
            tail = [x[cut:] for x in now]
            n += pairs(*(x[:cut] for x in now)) if cut else 0
            if n > _NODES // 4:
                yield from distinct()
                n = 0
        if len(tail[0]):
            pairs(*tail)
        if found:
            yield from distinct()

    return run


def _across(most: int, least: float, each: int):
    """Of runs, in order of their key, the pairs (a, b, more) between components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None

        def pairs(k, f, node, classes, root, wide):
            order = np.lexsort((_mixed(node.view(np.uint64)), k))
            k, f, node, classes, root, wide = (np.ascontiguousarray(x[order]) for x in (k, f, node, classes, root, wide))
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            got = []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                x, y, more = pairs_across(f[lo:hi], classes[lo:hi], wide[lo:hi], root[lo:hi], most, least, each)
                got.append((node[lo:hi][x], node[lo:hi][y], more))
            a, b, more = (np.concatenate(x) for x in zip(*got))
            return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(more)], names=["a", "b", "more"])

        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False).view(t) for i, t in enumerate((np.int32, np.uint64, np.int64, np.int64, np.int64))]
            now.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, WIDE))
            if not len(now[0]):
                continue
            if tail:
                now = [np.concatenate(x) for x in zip(tail, now)]
            cut = int(np.searchsorted(now[0], now[0][-1], "left"))
            tail = [x[cut:] for x in now]
            if cut:
                yield pairs(*(x[:cut] for x in now))
        if tail:
            yield pairs(*tail)

    return run


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wide classes in the place of the set of each (node, classes, runs, shingles)."""
    for batch in batches:
        wide = [wide_classes_of(np.frombuffer(x, np.uint32)).tobytes() for x in batch.column(3).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(wide, pa.binary())], names=["node", "classes", "runs", "wide"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each (node, classes, root, wide, runs) once for each of its runs (key, fp)."""
    for batch in batches:
        runs = batch.column(4)
        of, own = np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy(zero_copy_only=False)), runs.flatten()
        for at in range(0, len(of), 4096):
            row, some = pa.array(of[at : at + 4096]), own.slice(at, 4096).flatten()
            yield pa.record_batch([*some, *(batch.column(i).take(row) for i in range(4))], names=["key", "fp", "node", "classes", "root", "wide"])


def _similar(least: float):
    """Of pairs with their sets, those at least that similar, less those that close a circle within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ra, rb = find(a), find(b)
                if len(parent) > _NODES:
                    parent.clear()
                    ra, rb = find(a), find(b)
                if ra != rb and similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= least:
                    parent[ra] = rb
                    keep.append((a, b))
            yield pa.record_batch([pa.array([a for a, _ in keep], pa.int64()), pa.array([b for _, b in keep], pa.int64())], names=["a", "b"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b), those whose sets are at least that similar, less some that close a circle; written."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_similar(least), "a long, b long"))


def _linked_across(members: DataFrame, sets: DataFrame, nodes: DataFrame, least: float, most: int) -> DataFrame:
    """The components (node, root) after all pairs of the runs between different ones were compared.

    A member (node, classes, runs) is one row with all of its runs, at most about 30 for each fingerprint: it is joined
    once a round, and stands in each of its runs only after that.
    A member's pairs come in rounds of ROUND times as many as before, since most need none once a few have linked it;
    the last round is the one that holds none back. Pairs that were found different come again in the next round.
    """
    wide = written(members.join(sets, "node").select("node", "classes", "runs", "shingles").mapInArrow(_widened, f"node long, classes long, {_RUNS}, wide binary"))
    each = ROUND
    while True:
        rooted = wide.join(nodes, "node", "left").select("node", "classes", F.coalesce("root", "node").alias("root"), "wide", "runs")
        keyed = rooted.mapInArrow(_spread, "key int, fp long, node long, classes long, root long, wide binary").repartition("key").sortWithinPartitions("key")
        pairs = written(keyed.mapInArrow(_across(most, least, each), "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more")))
        more = pairs.agg(F.max("more")).first()[0]
        if more is not None:
            edges = _links(pairs.select("a", "b"), sets, least)
            old, nodes = nodes, components(edges.unionByName(nodes.select(F.col("root").alias("a"), F.col("node").alias("b"))))
            discard(old)
            discard(edges)
        discard(pairs)
        if not more:
            discard(wide)
            return nodes
        each *= ROUND


def _similar_rows(docs: DataFrame, least: float, n: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th: hash of the text, node) of every row, and (node, root) of every node; both written."""
    long_rows(docs.sparkSession)
    schema = "doc_id long, th long, node long, classes long" + "".join(f", fp{k} long" for k in range(n))
    rows = written(docs.select("doc_id", _text_hash().alias("th"), "text").mapInArrow(_noded(n), schema))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"fp{k}").alias("fp")) for k in range(n))))
    of_node = written(rows.select("node", "classes", each.alias("x")).select("x.k", "x.fp", "node", "classes").distinct())
    keyed = of_node.mapInArrow(_keyed_all, "key int, fp long, node long, classes long")
    found = written(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs(most, least), "key int, fp long, a long, b long, classes long"))
    discard(of_node)
    candidates = written(found.where("key is null").select("a", "b").distinct())
    runs = found.where("key is not null").select(F.col("a").alias("node"), "classes", F.struct("key", "fp").alias("run"))
    members = written(runs.groupBy("node", "classes").agg(F.collect_list("run").alias("runs")))
    discard(found)
    touched = candidates.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node")).distinct()
    sets = written(docs.select("text").mapInArrow(_sets, "node long, shingles binary").join(touched, "node", "left_semi").dropDuplicates(["node"]))
    edges = _links(candidates, sets, least)
    discard(candidates)
    nodes = components(edges)
    discard(edges)
    if not members.isEmpty():
        nodes = _linked_across(members, sets, nodes, least, most)
    discard(members)
    discard(sets)
    return rows, nodes


def similar_components(docs: DataFrame, least: float = LEAST_SIMILARITY, n: int = FINGERPRINTS, most: int = CANDIDATE_BITS) -> DataFrame:
    """(doc_id, th, component_id: smallest doc_id reachable) by links of Jaccard similarity `least` or more over five-word shingles.

    Candidates share a Golay key of one of n fingerprints and differ there in at most `most` bits; those that counts
    of their shingles by class show to be less similar fall out, and each other one is verified on its whole sets, or
    its texts are linked already: first a few of a long run, then all between different components. Texts of the same words are one node.
    """
    rows, nodes = _similar_rows(docs, least, n, most)
    rooted = _rooted(rows, nodes, F.min("doc_id"))
    id_of = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "th", "node").join(rooted.join(id_of, "root").select("node", "component_id"), "node").select("doc_id", "th", "component_id")


def _rooted(rows: DataFrame, nodes: DataFrame, first) -> DataFrame:
    return rows.groupBy("node").agg(first.alias("first")).join(nodes, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))


def _text_hash():
    return F.xxhash64(F.col("text").isNull(), "text")


def keep_one(docs: DataFrame, least: float = LEAST_SIMILARITY, n: int = FINGERPRINTS, most: int = CANDIDATE_BITS) -> DataFrame:
    """The documents with one of each near-duplicate group: that of the smallest doc_id (null last), then of the smallest text hash.

    A document is its doc_id and its text: texts that repeat nothing stay whether or not their doc_id is null or shared.
    Of rows with the same doc_id and the same text one stays, the first by their other columns.
    """
    rows, nodes = _similar_rows(docs, least, n, most)
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "th")
    keep = written(_rooted(rows, nodes, F.min(own)).groupBy("root").agg(F.min("first").alias("m")).select("m.*"))
    discard(rows)
    discard(nodes)
    marked = docs.withColumns({"__leafwork_id": F.coalesce("doc_id", F.lit(0)), "__leafwork_none": F.col("doc_id").isNull(), "__leafwork_th": _text_hash()})
    keep = keep.select(F.col("id").alias("__leafwork_id"), F.col("none").alias("__leafwork_none"), F.col("th").alias("__leafwork_th"))
    kept = marked.join(keep, keep.columns, "left_semi")
    others = F.to_json(F.struct(F.lit(0).alias("__leafwork"), *(c for c in docs.columns if c != "text")))
    nth = F.row_number().over(Window.partitionBy(*keep.columns).orderBy(others))
    return kept.withColumn("__leafwork_nth", nth).where("__leafwork_nth = 1").select(*docs.columns)
