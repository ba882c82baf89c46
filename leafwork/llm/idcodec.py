"""Token ids in a binary file format: canonical length-limited Huffman code, independent blocks, bit-offset checkpoints.

Writing takes two passes. The first tokenizes every text once and writes the ids
(compressed per document) with a count of ids per task; the counts of all tasks
give one canonical code of at most 18 bits (package-merge), whose code lengths
are the codebook. The second pass orders the documents by doc_id with a range
partitioning and writes blocks of about 2^18 ids. A block (magic HFB1) holds the
doc_ids, their id counts, a bit offset for every 256 ids and the bit stream; with
the codebook it can be decoded on its own. Decoding looks up 18 bits at a time
in one table, at all checkpoints of a block in step.

Edge cases: a null or empty text has only the end id; equal doc_ids are ordered
by a checksum of their ids; a null doc_id comes first; a document longer than a
block makes a block of its own; an empty table writes no blocks and reads back
no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import _ODD, discard, long_rows, pieces, word_spans, written

END = 1
LIMIT = 18
EVERY = 256
BLOCK_IDS = 1 << 18
#: Most entries of the tables of chunks and of letter runs in each task's process, and bytes of the texts that are encoded at a time.
_CHUNKS = 2_000_000
_CACHE = 400_000
_RUN = 6_000_000
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True
#: The first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Punctuation that is a piece of its own after letters (an apostrophe may start a piece with letters), and the first character beyond those whose lower case and composition are plain.
_CLOSING = string.punctuation.replace("'", "")
_LATIN = "\u0130"
_NO_ID = -(1 << 63)


# -- the code -----------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for the ids with a count; 0 for the others."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, kinds = leaves, []
    for _ in range(limit - 1):
        packed = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packed])
        at = np.argsort(both, kind="stable")
        kinds.append(at < n)
        row = both[at]
    size, m = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(kinds):
        own = int(leaf[:m].sum())
        size[:own] += 1
        m = 2 * (m - own)
    size[:m] += 1
    out[order] = size
    return out


class Code:
    """Canonical code of the given lengths: codes ascend by (length, id)."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        size = lengths[order].astype(np.int64)
        width = np.int64(1) << (LIMIT - size)
        begin = np.cumsum(width) - width
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (begin >> (LIMIT - size)).astype(np.uint64)
        self.id_at = np.zeros(1 << LIMIT, np.uint32)
        self.size_at = np.ones(1 << LIMIT, np.uint8)
        self.id_at[: width.sum()] = np.repeat(order, width)
        self.size_at[: width.sum()] = np.repeat(size, width)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream of ids, first bit highest, and the bit offset of every 256th id."""
        if not len(ids):
            return b"", np.zeros(0, np.uint32)
        size = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(size)
        begins = ends - size
        words = np.zeros((int(ends[-1]) + 63) // 64 + 1, np.uint64)
        word, shift = begins >> 6, 64 - (begins & 63) - size
        codes = self.codes[ids]
        inside = np.where(shift >= 0, codes << np.maximum(shift, 0).astype(np.uint64), codes >> np.maximum(-shift, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.bitwise_or.reduceat(inside, first)
        over = np.flatnonzero(shift < 0)
        words[word[over] + 1] |= codes[over] << (64 + shift[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], begins[::EVERY].astype(np.uint32)

    def unpack(self, stream: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, np.uint32)
        raw = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out = np.empty((EVERY, len(checkpoints)), np.uint32)
        at, last, most = checkpoints.astype(np.int64), (n - 1) % EVERY + 1, len(window) - 1
        for i in range(EVERY):
            if i == last:  # the last lane is shorter
                at = at[:-1]
                if not len(at):
                    break
            bits = window[np.minimum(at >> 3, most)] << (at & 7).astype(np.uint32) >> np.uint32(32 - LIMIT)
            out[i, : len(at)] = self.id_at[bits]
            at += self.size_at[bits]
        return out.T.ravel()[:n]


def block(code: Code, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    stream, marks = code.pack(ids)
    head = struct.pack("<4sIII", b"HFB1", len(doc_ids), len(ids), len(marks))
    return head + doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + marks.astype("<u4").tobytes() + stream


def read_block(code: Code, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, id counts and ids of a block."""
    magic, docs, n, marks = struct.unpack_from("<4sIII", raw)
    if magic != b"HFB1":
        raise ValueError("no block of ids")
    at = 16
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    counts = np.frombuffer(raw, "<u4", docs, at + 8 * docs)
    checkpoints = np.frombuffer(raw, "<u4", marks, at + 12 * docs)
    return doc_ids, counts, code.unpack(raw[at + 12 * docs + 4 * marks :], checkpoints, n)


# -- tokenizing ---------------------------------------------------------------


class Chunks:
    """A bounded table from chunks of at most 16 bytes to their ids: open addressing, keyed by the bytes themselves and their number."""

    def __init__(self, most: int, kind: np.dtype):
        bits = (2 * most).bit_length()
        self.most, self.used, self.shift = most, 0, np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.low, self.high, self.size = np.zeros(most, np.uint64), np.zeros(most, np.uint64), np.zeros(most, np.uint8)
        self.begin, self.n = np.zeros(most, np.int64), np.zeros(most, np.int32)
        self.pool, self.filled = np.zeros(5 * most, kind), 0

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(_ODD))) * np.uint64(_ODD)
        return (((h ^ (h >> np.uint64(32))) * np.uint64(_ODD)) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each chunk, -1 for those unknown."""
        slot = self._slot(low, high)
        entry = self.slots[slot]
        rest = np.flatnonzero((entry >= 0) & ((self.low[entry] != low) | (self.high[entry] != high) | (self.size[entry] != size)))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.slots) - 1)
            e = self.slots[slot[rest]]
            entry[rest] = e
            rest = rest[(e >= 0) & ((self.low[e] != low[rest]) | (self.high[e] != high[rest]) | (self.size[e] != size[rest]))]
        return entry

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Distinct unknown chunks with their ids, one after the other, as far as there is room."""
        room = min(self.most - self.used, int(np.searchsorted(np.cumsum(n), len(self.pool) - self.filled, "right")))
        low, high, size, n = low[:room], high[:room], size[:room], n[:room]
        new, total = np.arange(self.used, self.used + len(low), dtype=np.int32), int(n.sum())
        self.low[new], self.high[new], self.size[new] = low, high, size
        self.begin[new], self.n[new] = self.filled + np.cumsum(n) - n, n
        self.pool[self.filled : self.filled + total] = ids[:total]
        self.used, self.filled = self.used + len(new), self.filled + total
        slot = self._slot(low, high)
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]
            lost = self.slots[slot] != new
            new, slot = new[lost], (slot[lost] + 1) & (len(self.slots) - 1)


class Words:
    """Ids of texts by a tokenizer whose pre-tokenizer drops white space: encoded per chunk between spaces, chunks kept in bounded tables."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.n = self.tokenizer.get_vocab_size()
        self.wide = np.dtype("<u2" if self.n <= 65_536 else "<u4")
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(self.n, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.chunks = Chunks(_CHUNKS, self.wide)
        self.cores: dict[str, bytes] = {}

    def _each(self, chunks: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return {c: np.array(e.ids, self.wide).tobytes() for c, e in zip(chunks, found)}

    def _lines(self, cores: list[str]) -> dict[str, bytes]:
        """Letter runs, a line each: every line is one piece, and a piece ends with the only id of it that closes a word."""
        out = {}
        for at in range(0, len(cores), 4_000):
            part = cores[at : at + 4_000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, self.wide)
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * self.wide.itemsize).tolist()
            if len(ends) != len(part):
                out |= self._each(part)
                continue
            raw = ids.tobytes()
            out |= {c: raw[a:b] for c, a, b in zip(part, [0, *ends], ends)}
        return out

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks. One of Latin letters and closing punctuation falls apart into a piece for each, and letters count in lower case."""
        halves, whole, tails = [], [], {}
        for c in chunks:
            core = c if c.isalpha() else c.rstrip(_CLOSING)
            if core.isascii() and core.isalpha() or core.isalpha() and max(core) < _LATIN:
                tail = c[len(core) :]
                halves.append((c, core.lower(), tail))
                tails[tail] = b""
            else:
                whole.append(c)
        tails |= self._each([t for t in tails if t])
        known = self.cores
        keep = len(known) < _CACHE
        fresh = list({k for _, k, _ in halves if k not in known})  # a difference of sets would walk all that is known
        known.update(self._lines(fresh))
        out = {c: known[k] + tails[t] for c, k, t in halves}
        out |= self._each(whole)
        if not keep:
            for k in fresh:
                del known[k]
        return out

    def ids(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a buffer, one after the other, and their number for each text."""
        starts, ends, text = word_spans(raw, at, _BREAK)
        size = ends - starts
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        eight = np.ndarray(len(raw) + 9, "<u8", padded, strides=(1,))
        low = eight[starts] & _FIRST[np.minimum(size, 8)]
        high = eight[starts + np.minimum(size, 8)] & _FIRST[np.clip(size - 8, 0, 8)]
        table = self.chunks
        entry = table.find(low, high, np.minimum(size, 255).astype(np.uint8))
        long = np.flatnonzero(size > 16)
        entry[long] = -1
        fresh = np.flatnonzero(entry < 0)
        fresh = fresh[size[fresh] <= 16]
        fresh = fresh[np.lexsort((size[fresh], high[fresh], low[fresh]))]
        keys = np.stack([low[fresh], high[fresh], size[fresh].astype(np.uint64)])
        first = np.ones(len(fresh), bool)
        first[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        once = fresh[first]
        entry[fresh] = table.used + np.cumsum(first) - 1
        words = [padded[a:b].tobytes().decode() for a, b in zip(starts[once].tolist(), ends[once].tolist())]
        more: dict[str, int] = {}
        entry[long] = [more.setdefault(padded[a:b].tobytes().decode(), table.used + len(words) + len(more)) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        words += more
        learned = self._learn(words) if words else {}
        new = [learned[w] for w in words]
        n = np.array([len(x) // self.wide.itemsize for x in new], np.int32)
        own = np.frombuffer(b"".join(new), self.wide)
        begin = np.concatenate([table.begin[: table.used], table.filled + np.cumsum(n, dtype=np.int64) - n])
        count = np.concatenate([table.n[: table.used], n])
        pool = np.concatenate([table.pool[: table.filled], own])
        table.add(low[once], high[once], size[once].astype(np.uint8), own, n[: len(once)])
        size, begin = count[entry].astype(np.int64), begin[entry]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        out = pool[np.repeat(begin - stop + size, size) + np.arange(total)]
        return out, np.bincount(text, size, len(at) - 1).astype(np.int64)


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def _tokenized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, pack = _words(path), zstandard.ZstdCompressor(level=1)
        counts = np.zeros(max(words.n, END + 1), np.int64)
        for batch in batches:
            for row, data, at in pieces(batch.column(1), _RUN):
                ids, n = words.ids(data, at)
                ids, n = np.insert(ids, np.cumsum(n), END), n + 1
                counts += np.bincount(ids, minlength=len(counts))
                whole, ends = memoryview(np.ascontiguousarray(ids)).cast("B"), (np.cumsum(n) * ids.itemsize).tolist()
                raw = [whole[a:b] for a, b in zip([0, *ends], ends)]
                tie = pa.array([zlib.crc32(x) for x in raw], pa.int64())
                yield pa.record_batch([batch.column(0).slice(row, len(raw)), pa.array(n), tie, pa.array([pack.compress(x) for x in raw], pa.binary()), pa.nulls(len(raw), pa.int32()), pa.array(["ids"] * len(raw))], names=["doc_id", "n", "tie", "ids", "id", "kind"])
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.nulls(len(used), pa.int64()), pa.array(counts[used]), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary()), pa.array(used.astype(np.int32)), pa.array(["count"] * len(used))], names=["doc_id", "n", "tie", "ids", "id", "kind"])

    return run


# -- writing and reading ------------------------------------------------------


def _encoder(code, wide: np.dtype, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, unpack = TaskContext.get().partitionId(), 0, zstandard.ZstdDecompressor()
        docs, counts, raw, held = [], [], [], 0

        def flush():
            nonlocal start, docs, counts, raw, held
            ids = np.frombuffer(b"".join(raw), wide)
            out = block(code.value, np.array([_NO_ID if d is None else d for d in docs], np.int64), np.array(counts), ids)
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([out], pa.binary())], names=["part", "start", "n", "block"])
            start, docs, counts, raw, held = start + held, [], [], [], 0
            return row

        for batch in batches:
            for d, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                docs.append(d)
                counts.append(n)
                raw.append(unpack.decompress(x))
                held += n
                if held >= block_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


class Archive:
    """Blocks (part, start within the part, n, block) and the code lengths that they were written with."""

    def __init__(self, blocks: DataFrame, lengths: np.ndarray):
        self.blocks, self.lengths = blocks, lengths

    def read(self) -> DataFrame:
        """doc_id, start (ids before it), n_tokens, ids_crc32 (of its ids as 32-bit integers), from the blocks alone."""
        spark = self.blocks.sparkSession
        code = spark.sparkContext.broadcast(Code(self.lengths))  # bounded by the vocabulary and 2^18 table rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, start, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    doc_ids, counts, ids = read_block(code.value, raw)
                    ends = np.cumsum(counts, dtype=np.int64)
                    whole = memoryview(ids.astype("<u4")).cast("B")
                    crc = [zlib.crc32(whole[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                    null = doc_ids == _NO_ID
                    yield pa.record_batch([pa.array(np.full(len(ends), part, np.int32)), pa.array(doc_ids, mask=null), pa.array(start + ends - counts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

        rows = self.blocks.select("part", "start", "block").mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
        sums = self.blocks.groupBy("part").agg(F.sum("n").alias("n"))  # one row a partition
        before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
        return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def write(docs: DataFrame, path: str, block_ids: int = BLOCK_IDS) -> Archive:
    """Tokenize every text, append the end id and write the blocks in ascending doc_id order."""
    long_rows(docs.sparkSession)
    spark = docs.sparkSession
    both = written(docs.select("doc_id", "text").mapInArrow(_tokenized(path), "doc_id long, n long, tie long, ids binary, id int, kind string"), "kind", compression="none")
    counts = both.where("kind = 'count'").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    totals = np.zeros(max(END + 1, int(np.max(counts["id"].to_numpy(), initial=0)) + 1), np.int64)
    totals[counts["id"].to_numpy()] = counts["n"].to_numpy()
    lengths = code_lengths(totals)
    code = spark.sparkContext.broadcast(Code(lengths))
    tokens = both.where("kind = 'ids'").select("doc_id", "n", "ids", "tie")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(n_parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    wide = np.dtype("<u2") if _words(path).n <= 65_536 else np.dtype("<u4")
    blocks = written(ordered.select("doc_id", "n", "ids").mapInArrow(_encoder(code, wide, block_ids), "part int, start long, n long, block binary"), compression="none")
    discard(both)
    return Archive(blocks, lengths)
