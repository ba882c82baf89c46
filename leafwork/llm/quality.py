"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Words are runs of bytes other than ASCII white space, lower-cased over A-Z, and
are kept in 2^16 buckets by hash. Every bucket has a fixed sparse ternary index
vector; the word vector of a bucket is the sum of the index vectors of its left
and right neighbours over all texts, so one pass over the corpus makes them. A
document is the mean and the spread of the unit word vectors of its words. Two
dense layers (tanh, then a logit) are trained with numpy on a bounded sample of
labelled documents, and a temperature fitted on a part of the sample that was
not trained on calibrates the probabilities.

Edge cases: null, empty and blank texts are the zero vector and get the
network's score of it; with labels of one class only, or none, every score is
the (smoothed) share of good labels; a document labelled more than once takes
the higher label; repeated rows each have a row; an empty table gives no rows.
Columns other than doc_id and text are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm.common import fold, long_rows, pieces, span_hashes, word_spans, written

BUCKETS, DIM, NONZERO = 1 << 16, 64, 4
#: Bound of the sample of labelled documents that the network is fitted on.
MOST_LABELLED = 20_000
HIDDEN, SEED, CUT = 32, 11, 0.3
_BLOCK = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector, from a fixed seed."""
    draw = np.random.default_rng(SEED)
    return draw.integers(0, DIM, (BUCKETS, NONZERO)).astype(np.int32), np.where(draw.random((BUCKETS, NONZERO)) < 0.5, -1.0, 1.0)


def buckets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word."""
    raw = _LOWER[raw]
    starts, ends, text = word_spans(raw, at)
    return (span_hashes(raw, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64), text


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    for batch in batches:
        for _, raw, at in pieces(batch.column(0), 4_000_000):
            b, text = buckets(raw, at)
            near = text[1:] == text[:-1]
            left, right = b[:-1][near], b[1:][near]
            for k in range(NONZERO // 2):
                total += np.bincount(left * DIM + place[right, k], sign[right, k], BUCKETS * DIM)
                total += np.bincount(right * DIM + place[left, k + NONZERO // 2], sign[left, k + NONZERO // 2], BUCKETS * DIM)
    blocks = total.reshape(-1, _BLOCK * DIM)
    used = np.flatnonzero(blocks.any(1))
    yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array([blocks[i].astype("<i8").tobytes() for i in used], pa.binary())], names=["block", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(raw.as_buffer(), "<i8")
            sums[i] = sums[i] + x if i in sums else x.copy()
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vector of each bucket (zero for unused ones), from all texts of docs. Its size is fixed by BUCKETS and DIM."""
    spark = docs.sparkSession
    most = 4 * max(1, spark.sparkContext.defaultParallelism)  # partial sums for a few tasks a slot, not for every split
    parts = docs.select("text").coalesce(most).mapInArrow(_contexts, "block int, sums binary")
    sums = parts.repartition("block").mapInArrow(_added, "block int, sums binary").toArrow()
    out = np.zeros((BUCKETS // _BLOCK, _BLOCK * DIM))
    for i, raw in zip(sums["block"].to_pylist(), sums["sums"].to_pylist()):
        out[i] += np.frombuffer(raw, "<i8")
    out = out.reshape(BUCKETS, DIM)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).astype(np.float32)


def pool(vectors: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text."""
    n = len(at) - 1
    out = np.zeros((n, 2 * DIM), np.float32)
    b, text = buckets(raw, at)
    if not len(b):
        return out
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    count = np.diff(np.concatenate([starts, [len(text)]]))[:, None]
    x = vectors[b]
    mean = np.add.reduceat(x, starts, axis=0) / count
    np.multiply(x, x, out=x)
    spread = np.sqrt(np.maximum(np.add.reduceat(x, starts, axis=0) / count - mean * mean, 0))
    out[text[starts]] = np.concatenate([mean, spread], 1)
    return out


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, vec (float32 bytes) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, at in pieces(batch.column(1), 1_000_000):
                rows = pool(shared.value, raw, at)
                yield pa.record_batch([batch.column(0).slice(first, len(rows)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "vec"])

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, vec binary"))


class Network:
    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, rounds: int = 40):
        draw = np.random.default_rng(SEED)
        self.share = (y.sum() + 1) / (len(y) + 2)
        self.flat = len(y) < 10 or y.min() == y.max()
        if self.flat:
            return
        self.mid, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mid) / self.scale
        held = draw.random(len(y)) < 0.2
        held[:2] = False
        w1, b1 = draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden)
        w2, b2 = draw.normal(0, hidden**-0.5, hidden), np.log(self.share / (1 - self.share))
        self.weights = [w1, b1, w2, np.array(b2)]
        m, v, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        fit_x, fit_y = x[~held], y[~held]
        for _ in range(rounds):
            order = draw.permutation(len(fit_y))
            for at in range(0, len(order), 256):
                rows = order[at : at + 256]
                h = np.tanh(fit_x[rows] @ self.weights[0] + self.weights[1])
                d = (1 / (1 + np.exp(-(h @ self.weights[2] + self.weights[3]))) - fit_y[rows]) / len(rows)
                dh = np.outer(d, self.weights[2]) * (1 - h * h)
                grads = [fit_x[rows].T @ dh + 1e-4 * self.weights[0], dh.sum(0), h.T @ d + 1e-4 * self.weights[2], d.sum()]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * np.square(g)
                    self.weights[i] = self.weights[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        z, t = self._logit(x[held]), y[held]
        loss = lambda k: np.mean(np.logaddexp(0, np.where(t > 0, -z, z) / k)) if len(t) else abs(np.log(k))
        self.temperature = min(np.exp(np.linspace(-1.5, 2.5, 161)), key=loss)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(x @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-self._logit((x - self.mid) / self.scale) / self.temperature))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, 2 * DIM).astype(np.float64)


def fit(vecs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Network:
    """Network from at most about `most` labelled rows, chosen by a hash of doc_id over all of them. labels: doc_id, quality."""
    rated = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = rated.count()
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = rated.where(draw < most / max(n, 1)) if n > most else rated
    rows = vecs.join(chosen, "doc_id").select("doc_id", "vec", "quality").toArrow()
    if not rows.num_rows:
        return Network(np.zeros((0, 2 * DIM)), np.zeros(0))
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    return Network(_matrix(rows["vec"])[order], (rows["quality"].to_numpy() > 0).astype(float)[order])


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels only from rows that are not held out."""
    long_rows(docs.sparkSession)
    spark: SparkSession = docs.sparkSession
    vecs = pooled(docs, word_vectors(docs))
    net = spark.sparkContext.broadcast(fit(vecs, labels.where(fold("doc_id", folds) != held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), pa.array(net.value.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    out = vecs.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
