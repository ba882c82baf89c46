"""Language identification by prediction by partial matching over bytes.

For each language a context tree of orders 0 to 3 is counted over a bounded
sample of labelled texts and then frozen. A byte seen in its context costs
-log2(c / (n + d)) bits (c its count, n the context's count, d the distinct
bytes seen in it); otherwise it costs the escape -log2(d / (n + d)) and what it
costs in the next shorter context. A context a language never saw is skipped
without cost; a byte unseen at order 0 costs 8 bits more. There is no exclusion.
Costs are kept in units of 2^-16 bit, so that sums do not depend on the order of
adding. A text starts in the context of three line feeds. The language with the
shortest code is predicted. The pipeline's stage rejects what no learned language
codes well: texts without a letter, and texts whose shortest code exceeds 4.5 bits
a byte and 64 bits once (noise, keys and numbers, scripts that were not learned);
prose takes 2 to 3 bits a byte. Where lang is null it enters the prediction.

Edge cases: null, empty and letterless texts are `und` with score 0; a tie goes
to the first language by name; without any labelled text every prediction is
`und`; whole texts are scored whatever their length; repeated rows each have a
row. Columns other than doc_id, text and (for learning) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.llm.common import fold, long_rows, pieces

ORDER = 3
UNIT = 1 << 16
#: Bounds of the sample that the trees are learned from.
DOCS_PER_LANGUAGE = 500
BYTES_PER_LANGUAGE = 2_000_000
#: A text whose shortest code takes more than so many bits a byte, and so many once for its beginning, is no text of a learned language.
REJECT_BITS, ONCE_BITS = 4.5, 64.0


class Trees:
    """Frozen costs: row[context] leads to the costs of the longest context that any language saw."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        data = {n: [np.frombuffer(("\n" * ORDER + t).encode("utf-8", "surrogatepass"), np.uint8) for t in texts[n]] for n in self.languages}
        seen = np.zeros(256, bool)
        seen[10] = True
        for parts in data.values():
            for p in parts:
                seen[p] = True
        self.symbol = np.zeros(256, np.int64)  # 0: never seen in the sample
        self.symbol[seen] = np.arange(1, seen.sum() + 1)
        self.start = int(self.symbol[10])
        a, many = self.a, _ = int(seen.sum()) + 1, len(self.languages)
        grams = {}
        for n in self.languages:
            for k in range(ORDER + 1):
                codes = []
                for p in data[n]:
                    s = self.symbol[p]
                    code = np.zeros(max(0, len(s) - ORDER), np.int64)
                    for j in range(k + 1):
                        code = code * a + s[ORDER - k + j : len(s) - k + j]
                    codes.append(code)
                grams[n, k] = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)
        # rows: the empty context, then the contexts seen at each order, by code
        contexts = [np.zeros(1, np.int64)] + [np.unique(np.concatenate([grams[n, k][0] // a for n in self.languages])) for k in range(1, ORDER + 1)]
        first = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        self.cost = np.zeros((first[-1], a, many), np.int32)
        shorter = np.full((1, a, many), 8.0)
        for k, codes in enumerate(contexts):
            if k:
                shorter, below = cost, np.searchsorted(contexts[k - 1], codes % a ** (k - 1))
            else:
                below = np.zeros(1, np.int64)
            cost = np.zeros((len(codes) if k < ORDER else 0, a, many))
            for lo in range(0, len(codes), 2048):  # in parts: the counts of all contexts would not be small
                part = codes[lo : lo + 2048]
                count = np.zeros((len(part), a, many))
                for m, n in enumerate(self.languages):
                    g, c = grams[n, k]
                    i, j = np.searchsorted(g, [part[0] * a, (part[-1] + 1) * a])
                    count[np.searchsorted(part, g[i:j] // a), g[i:j] % a, m] = c[i:j]
                total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    own = -np.log2(count / (total + kinds))
                    escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                got = np.where(count > 0, own, escape + shorter[below[lo : lo + 2048]])
                self.cost[first[k] + lo : first[k] + lo + len(part)] = np.rint(got * UNIT)
                if k < ORDER:
                    cost[lo : lo + len(part)] = got
        self.cost = self.cost.reshape(-1, many)
        row = np.zeros(1, np.int32)
        for k in range(1, ORDER + 1):  # row of each context of order k: its own, else that of the shorter one
            row = np.tile(row, a)
            row[contexts[k]] = np.arange(first[k], first[k + 1])
        self.row = row

    def lengths(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each text in each language, in units."""
        out = np.zeros((len(at) - 1, len(self.languages)), np.int64)
        full = np.flatnonzero(at[1:] > at[:-1])
        if not len(full):
            return out
        s, begins = self.symbol[raw], at[:-1][full]
        context, last = np.zeros(len(s), np.int64), s
        for j in range(ORDER):
            moved = np.empty_like(last)
            moved[1:] = last[:-1]
            moved[begins] = self.start
            context += moved * self.a**j
            last = moved
        costs = self.cost[self.row[context].astype(np.int64) * self.a + s]
        out[full] = np.add.reduceat(costs, begins, axis=0, dtype=np.int64)
        return out


def sample(docs: DataFrame, most_docs: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(lang, text, h): about most_docs texts of each language, chosen by a hash of doc_id from all rows of docs with a language and a text."""
    of = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64(F.lit(4), "doc_id").alias("h"))
    counts = of.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], most_docs / r["n"])]) if counts else F.create_map().cast("map<string,double>")
    return of.where(F.pmod("h", F.lit(1_000_003)) / F.lit(1_000_003.0) < share[F.col("lang")])


def learn(docs: DataFrame, most_docs: int = DOCS_PER_LANGUAGE, most_bytes: int = BYTES_PER_LANGUAGE) -> Trees | None:
    """Trees from a sample of at most most_bytes of text a language: in order of the hash, as long as the bytes so far fit. The cut is made before anything comes to the driver; single texts longer than that are not learned from."""
    so_far = Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = sample(docs, most_docs).where(F.octet_length("text") <= most_bytes).withColumn("so_far", F.sum(F.octet_length("text")).over(so_far)).where(F.col("so_far") <= most_bytes)
    texts: dict[str, list[str]] = {}
    for r in sorted(fits.select("lang", "so_far", "text").collect(), key=lambda r: (r["lang"], r["so_far"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return Trees(texts) if texts else None


def _scorer(trees):
    names = np.array(trees.value.languages, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trees.value
        for batch in batches:
            parts = [(model.lengths(raw, at), np.diff(at)) for _, raw, at in pieces(batch.column(1), 1_000_000)]
            if not parts:
                continue
            bits = np.concatenate([p for p, _ in parts]) / UNIT
            size = np.concatenate([s for _, s in parts])
            best = bits.argmin(1)
            low = bits[np.arange(len(best)), best]
            score = 1.0 / np.exp2(np.minimum(0.0, low[:, None] - bits)).sum(1)
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            pred = np.where(letters, names[best], "und")
            yield pa.record_batch([batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(np.where(size > 0, low / np.maximum(size, 1), 0.0))], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return run


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of every whole text."""
    long_rows(docs.sparkSession)
    spark: SparkSession = docs.sparkSession
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", "text", lettered.alias("lettered"))
    if trees is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    shared = spark.sparkContext.broadcast(trees)  # bounded by the sample
    return rows.mapInArrow(_scorer(shared), "doc_id long, lang_pred string, score double, bits_per_byte double")


def identified(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Prediction for every document; the trees are learned from the documents that are not held out."""
    model = learn(docs.where(fold("doc_id", folds) != held))
    return predict(docs, model).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_known(docs: DataFrame, trees: Trees | None, reject_bits: float = REJECT_BITS, once_bits: float = ONCE_BITS) -> DataFrame:
    """The rows whose text has a letter and a shortest code of at most reject_bits a byte and once_bits once; all columns pass through, a null lang becomes the predicted one. Without trees only the letters count."""
    long_rows(docs.sparkSession)
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    if trees is None:
        return lettered
    shared, where = docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index("text")
    lang = docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array(model.languages, pa.string())
        for batch in batches:
            parts = [(model.lengths(raw, at), np.diff(at)) for _, raw, at in pieces(batch.column(where), 1_000_000)]
            if parts:
                bits, size = np.concatenate([b for b, _ in parts]), np.concatenate([n for _, n in parts])
                if lang is not None:
                    batch = batch.set_column(lang, batch.schema.names[lang], _filled(batch.column(lang), names.take(pa.array(bits.argmin(1)))))
                yield batch.filter(pa.array(bits.min(1) <= UNIT * (reject_bits * size + once_bits)))

    return lettered.mapInArrow(run, docs.schema)


def _filled(values: pa.Array, others: pa.Array) -> pa.Array:
    return pc.if_else(values.is_null(), others.cast(values.type), values)
