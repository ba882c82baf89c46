"""Substring dedup by hashing lines, and the sentences of lines.

A unit is a line of at least six words, or a sentence of at least six words in
a line of several sentences (a sentence ends with a word whose last character is
. ! or ?), so that a passage that was pasted into the middle of a line is found
as well. Shorter lines and sentences are units together with their neighbours:
from each one the shortest run onward and the shortest run back that have six
words, over line ends, so that a repeated list, verse, form or short sentence is
found too. So that a passage of over 50 words is found wherever its sentences are
cut, runs of 12 to 24 words between boundaries set by the words alone are units
as well; up to 13 words stay at its start and 26 at its end where its sentences
are cut. Runs overlap, and each removed one has its row.
Units are normalised (lower case, white space as single spaces), their 96-bit
digests and numbers of words are grouped over all documents, the occurrence of lowest rank (doc_id,
then text hash, then offset) is kept and every other one is removed. Offsets are
code points of the original text. A sentence in a removed line is not reported
again.

A very common unit does not land in one task: each Arrow batch marks its
occurrences beyond the first as repeats on the spot, so that only one a batch is
grouped by digest. Whatever the batches are, the same units go, and each row
names the one occurrence that is kept.

Edge cases: null and empty texts have no units and stay as they are; a unit that
repeats within one document keeps its first place; rows with the same doc_id and
the same text are one document and are treated alike; a null doc_id ranks first;
an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import long_rows, written

LEAST_WORDS = 6
#: A repeated passage of so many words is found wherever it stands: REACH + WINDOW - 1 + REACH + REACH + 1 <= PASSAGE.
PASSAGE, WINDOW, REACH = 51, 12, 13
#: Parts that the rows of a digest with repeats found in batches are dealt over.
SALT = 16
#: Passes over the texts, each for the digests of one remainder: the shuffle of units, wider than the texts, is on disk by parts only.
PASSES = 2
#: Units that a task marks at once.
_MARKED = 250_000
_ODD, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: span: start and stop in 32 bits each; d2: number of words and 32 bits of the digest. What rows of a document share stands first, what is mostly zero last, and rows come by document, so that the shuffle's blocks compress.
_UNITS = "doc_id long, th long, span long, d1 long, d2 long, line int, known boolean, more boolean"


@dataclass
class Units:
    """Units of a text as arrays: start of the line (of runs: -1 minus their start), start and stop in code points, words, digest."""

    line: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    words: np.ndarray
    d1: np.ndarray
    d2: np.ndarray


_POWERS = [np.ones(1, np.uint64)] * 4


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of two odd numbers and of their inverses, kept for later texts."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 2 * len(_POWERS[0]), 1 << 12)
        for i, base in enumerate((int(_ODD), int(_MORE), pow(int(_ODD), -1, 1 << 64), pow(int(_MORE), -1, 1 << 64))):
            _POWERS[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)])
    return _POWERS


def _mixed(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    h = (h ^ n.astype(np.uint64) ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def units(text: str, least: int = LEAST_WORDS) -> Units | None:
    """The units of a text, or None where it has fewer than `least` words."""
    low = text.lower().encode("utf-8", "surrogatepass").split()
    n = len(low)
    if n < least:
        return None
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.diff(np.concatenate([[True], (chars == 32) | ((chars >= 9) & (chars <= 13)), [True]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, low)), ">u8").astype(np.uint64).reshape(-1, 2)

    # lines and sentences as runs of words [from, to)
    breaks = np.flatnonzero(chars == 10)
    line = np.searchsorted(breaks, starts)
    line_start = np.concatenate([[0], breaks + 1])[line]
    line_stop = np.concatenate([breaks, [len(chars)]])[line]
    new_line = np.concatenate([[True], line[1:] != line[:-1]])
    last = chars[stops - 1]
    ends = (last == 46) | (last == 33) | (last == 63)
    new_atom = new_line.copy()
    new_atom[1:] |= ends[:-1]
    la, sa = np.flatnonzero(new_line), np.flatnonzero(new_atom)
    lb, sb = np.append(la[1:], n), np.append(sa[1:], n)
    a_start = np.where(new_line[sa], line_start[sa], starts[sa])
    a_stop = np.where(np.append(new_line, True)[sb], line_stop[sa], starts[np.minimum(sb, n - 1)])

    keep = lb - la >= least
    parts = [(line_start[la][keep], line_start[la][keep], line_stop[la][keep], la[keep], lb[keep])]
    keep = (sb - sa >= least) & ~(new_line[sa] & np.append(new_line, True)[sb])
    parts.append((line_start[sa][keep], a_start[keep], a_stop[keep], sa[keep], sb[keep]))

    # the shortest runs of sentences that begin, or end, with a short one and have `least` words
    short = np.flatnonzero(sb - sa < least)
    on = np.searchsorted(sb, sa[short] + least)
    back = np.searchsorted(sa, sb[short] - least, "right") - 1
    i = np.concatenate([short[on < len(sb)], back[back >= 0]])
    j = np.concatenate([on[on < len(sb)], short[back >= 0]])
    if len(i):
        i, j = np.divmod(np.unique(i * np.int64(len(sb)) + j), len(sb))
        parts.append((-1 - a_start[i], a_start[i], a_stop[j], sa[i], sb[j]))
    if n >= PASSAGE:
        a, b = windows(h[:, 0])
        parts.append((-1 - starts[a], starts[a], stops[b - 1], a, b))

    begin, start, stop, a, b = (np.concatenate(x) for x in zip(*parts))
    powers = _powers(n)
    d1, d2 = (
        _mixed((total[b] - total[a]) * powers[2 + k][a], b - a)
        for k in (0, 1)
        for total in [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[:, k] * powers[k][:n], dtype=np.uint64)])]
    )
    return Units(begin, start, stop, b - a, d1, d2)


def windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs [from, to) of words, given by their hashes, between boundaries that the words alone decide; from each boundary the shortest onward of WINDOW words.

    A boundary is the least hash of two words in some stretch of REACH. In a passage of PASSAGE words the first one
    comes within REACH words, the last one at most REACH + 1 before the end, and a run is at most WINDOW - 1 + REACH
    words long, so one lies within the passage wherever it stands.
    """
    h = (words[:-1] ^ (words[1:] * _ODD)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    least = np.lib.stride_tricks.sliding_window_view(h, REACH).argmin(axis=1) + np.arange(len(h) - REACH + 1)
    bounds = least[np.concatenate([[True], least[1:] != least[:-1]])]
    on = np.searchsorted(bounds, bounds + WINDOW)
    return bounds[on < len(bounds)], bounds[on[on < len(bounds)]]


def _units(least: int, part: int):
    """Units of each batch. Of equal ones the first by rank goes on to be grouped by its digest (`more`: others follow it); the others are known to be repeats, which is all their row is for."""

    def marked(doc_ids: pa.Array, hashes: np.ndarray, at: list[int], found: list[Units]) -> pa.RecordBatch:
        ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
        none = doc_ids.is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((hashes, ids, ~none))
        rank = np.empty(len(order), np.int64)
        like = lambda *xs: np.concatenate([[False], np.logical_and.reduce([x[1:] == x[:-1] for x in xs])])[: len(xs[0])]
        rank[order] = np.cumsum(~like(hashes[order], ids[order], none[order]))
        row = np.repeat(np.array(at, np.int64), [len(u.start) for u in found])
        line, start, stop, words, d1, d2 = (np.concatenate([getattr(u, c) for u in found]) for c in ("line", "start", "stop", "words", "d1", "d2"))
        d2 = words << 32 | (d2 >> np.uint64(32)).astype(np.int64)
        own = d1 % np.uint64(PASSES) == part
        row, line, start, stop, d1, d2 = (x[own] for x in (row, line, start, stop, d1, d2))
        by = np.lexsort((stop, start, rank[row], d2, d1))
        row, line, start, stop, d1, d2 = (x[by] for x in (row, line, start, stop, d1, d2))
        once = ~like(d1, d2, rank[row], start, stop, line)
        row, line, start, stop, d1, d2 = (x[once] for x in (row, line, start, stop, d1, d2))
        begins = ~like(d1, d2)
        head = np.flatnonzero(begins)[np.cumsum(begins) - 1] if len(row) else row
        # the same words at the same place, with other white space after them, are no repeat of themselves
        known = (rank[row] != rank[row[head]]) | (start != start[head])
        more = np.zeros(len(row), bool)
        more[head[known]] = True
        by = np.argsort(row, kind="stable")
        row, span, d1, d2, line, known, more = (x[by] for x in (row, start << 32 | stop, d1.view(np.int64), d2, line.astype(np.int32), known, more))
        return pa.record_batch([doc_ids.take(pa.array(row)), pa.array(hashes[row]), *map(pa.array, (span, d1, d2, line, known, more))], names=["doc_id", "th", "span", "d1", "d2", "line", "known", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            at, found, n = [], [], 0
            for i, t in enumerate(texts):
                got = units(t.as_py(), least) if t.is_valid else None
                if got is not None:
                    at.append(i)
                    found.append(got)
                    n += len(got.start)
                if n > _MARKED or found and i + 1 == len(texts):
                    yield marked(ids, hashes, at, found)
                    at, found, n = [], [], 0

    return run


_HIGH, _LOW = (lambda c: F.shiftright(c, 32)), (lambda c: F.shiftright(F.shiftleft(c, 32), 32))


def _again(docs: DataFrame, least: int, part: int) -> DataFrame:
    """Every unit of the pass, with the place of the least rank of its digest as `first` where it was grouped by it.

    Known repeats need no grouping: their d1 is mixed with their own place, which deals them evenly; mixing it again gives it back.
    """
    long_rows(docs.sparkSession)
    found = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_units(least, part), _UNITS)
    found = found.withColumn("d1", _dealt())
    ranked = Window.partitionBy("d1", "d2").orderBy("doc_id", "th", "span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.withColumn("first", F.first(_place()).over(ranked))


def _passes(docs: DataFrame, least: int, of) -> DataFrame:
    """What `of` takes from the units of each pass, written; the shuffle files of one pass are gone before the next one."""
    out = []
    for part in range(PASSES):
        out.append(written(of(_again(docs, least, part))))
    return reduce(DataFrame.unionByName, out)


def _dealt():
    return F.when(F.col("known"), F.col("d1").bitwiseXOR(F.xxhash64("doc_id", "th", "span"))).otherwise(F.col("d1"))


def _place():
    return F.struct("doc_id", "th", _HIGH("span").alias("start"))


def repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """One row for each removed unit: doc_id, th (text hash), start_char, end_char, n_words, digest, first_doc_id, first_start of the kept occurrence."""
    gone = _passes(docs, least, lambda found: found.where(F.col("known") | (_place() > F.col("first")) | F.col("more")))
    heads = gone.where("more").groupBy("d1", "d2").agg(F.min("first").alias("first")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salt = F.pmod(F.xxhash64("doc_id", "th", "span"), F.lit(SALT)).cast("int")
    known = gone.where("known").drop("first").withColumn("d1", _dealt()).withColumn("salt", salt).join(heads, ["d1", "d2", "salt"])
    # written, so that the shuffle of this join is gone before the next one
    rows = gone.where(~F.col("known") & (_place() > F.col("first"))).unionByName(written(known.drop("salt")))
    rows = rows.where(_place() > F.col("first")).withColumns({"start": _HIGH("span"), "stop": _LOW("span")})
    # a line that is removed reaches further than its first sentence and covers all of them
    of_line = Window.partitionBy("doc_id", "th", "line").orderBy("span", "d1", "d2")
    before = F.lag(F.struct("span", "d1", "d2")).over(of_line)
    until = F.max(F.when(F.col("start") == F.col("line"), F.col("stop"))).over(of_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.select("*", before.alias("before"), until.alias("until")).where(F.col("before").isNull() | (F.col("before") != F.struct("span", "d1", "d2")))
    keep = F.col("until").isNull() | ((F.col("start") == F.col("line")) & (F.col("stop") == F.col("until"))) | (F.col("stop") > F.col("until"))
    digest = F.concat(F.lower(F.lpad(F.hex("d1"), 16, "0")), F.lower(F.lpad(F.hex(_LOW("d2").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
    return rows.where(keep).select("doc_id", "th", F.col("start").cast("int").alias("start_char"), F.col("stop").cast("int").alias("end_char"), _HIGH("d2").cast("int").alias("n_words"), digest.alias("digest"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").cast("int").alias("first_start"))


def _cut(text: str, spans) -> str:
    """text without the spans; a removed unit takes one line feed after it along."""
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at:a] if a > at else "")
        at = max(at, b + (text[b : b + 1] == "\n" and (a == 0 or text[a - 1] == "\n")))
    return "".join(out) + text[at:]


def without_repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """All rows and columns of docs, with the repeated units cut out of text."""
    spans = _passes(docs, least, lambda found: found.where(F.col("known") | (_place() > F.col("first"))).select("doc_id", "th", "span"))
    spans = spans.groupBy(F.col("doc_id").alias("__l_id"), F.col("th").alias("__l_th")).agg(F.collect_set("span").alias("__l_spans"))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["__l_id"]) & (F.xxhash64(docs["text"]) == spans["__l_th"]), "left").select(docs["*"], "__l_spans")
    names, schema = docs.columns, docs.schema
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = batch.column(where), batch.column(len(names))
            new = [t if s is None or t is None else _cut(t, {(x >> 32, x & 0xFFFFFFFF) for x in s}) for t, s in zip(text.to_pylist(), spans.to_pylist())]
            columns = [batch.column(i) for i in range(len(names))]
            columns[where] = pa.array(new, pa.string())
            yield pa.record_batch(columns, names=names)

    return joined.mapInArrow(run, schema)
