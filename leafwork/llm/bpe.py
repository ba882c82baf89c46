"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

A text is cut into chunks at single spaces, which are always boundaries of the
pre-tokenizer's pieces; a text with other runs of white space is cut by the
pre-tokenizer's pattern as a whole. Chunks seen before come from a bounded cache
in the worker. The pieces of all other chunks of a batch are merged together:
their symbols lie in one flat array, the rank of each adjacent pair is found by
binary search over the sorted pair keys, and in each round every piece merges
all places of its pair of lowest rank, until no pair has a rank. Decoding looks
up the bytes of the ids and reads them as UTF-8 with replacement.

Edge cases: null and empty texts have no ids; the strings of added tokens in a
text become those tokens, as in the library; any bytes can be encoded; whole
texts are encoded whatever their length; repeated rows each have a row. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from leafwork.llm.common import long_rows

#: Pre-tokenizer pattern of byte-level BPE vocabularies of this kind (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE = 150_000


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabularies, by rule: printable Latin-1 for itself, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        symbols = _byte_symbols()
        self.n = max(vocab.values()) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left * self.n + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.by_rank = made
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        words: dict[int, bytes] = {i: bytes(symbols[c] for c in t) for t, i in vocab.items() if t not in self.added}
        words |= {i: t.encode() for t, i in self.added.items()}
        size = max(words) + 1
        parts = [words.get(i, b"") for i in range(size)]
        self.length = np.array([len(p) for p in parts], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        one = {symbols[t]: i for t, i in vocab.items() if len(t) == 1 and t in symbols}
        self.of_byte = np.array([one[b] for b in range(256)], np.int32)
        self.pieces = regex.compile(PATTERN)
        self.runs = regex.compile(r"\s\s|^\s|\s\Z|[\x1c-\x1f\x85]")
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.wide = np.uint32 if size > 65_536 else np.uint16
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.piece_cache: dict[str, tuple[bytes, str]] = {}

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces in one flat array, and the end of each piece in it."""
        size = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), size)
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
        done_ids, done_word, done_at = [], [], []
        at = np.arange(len(ids))
        none = len(self.keys)
        while len(ids):
            same = word[1:] == word[:-1]
            keys = ids[:-1] * self.n + ids[1:]
            i = np.searchsorted(self.keys, keys)
            i[i == none] = 0
            rank = np.where(same & (self.keys[i] == keys), self.rank[i], none)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            best = np.minimum.reduceat(np.concatenate([rank, [none]]), starts)
            # a last symbol has no pair of its own: the rank stored there is none by `same`
            span = np.diff(np.concatenate([starts, [len(ids)]]))
            best_of = np.repeat(best, span)
            over = best_of == none
            if over.any():
                done_ids.append(ids[over])
                done_word.append(word[over])
                done_at.append(at[over])
                live = ~over
                hit = np.concatenate([(rank == best_of[:-1]), [False]])[live]
                ids, word, at, best_of = ids[live], word[live], at[live], best_of[live]
            else:
                hit = np.concatenate([(rank == best_of[:-1]), [False]])
            if not len(ids):
                break
            # of places that overlap (as in aaa) every second one from the left
            run = hit & np.concatenate([[False], hit[:-1]])
            if run.any():
                first = np.flatnonzero(hit & ~run)
                place = np.flatnonzero(hit)
                since = place - first[np.searchsorted(first, place, "right") - 1]
                hit[place[since % 2 == 1]] = False
            ids = np.where(hit, self.by_rank[np.minimum(best_of, none - 1)], ids)
            keep = np.concatenate([[True], ~hit[:-1]])
            ids, word, at = ids[keep], word[keep], at[keep]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        order = np.argsort(np.concatenate(done_at), kind="stable")
        flat = np.concatenate(done_ids)[order]
        return flat, np.cumsum(np.bincount(np.concatenate(done_word), minlength=len(words)))

    def cut(self, text: str) -> list[str]:
        """Chunks of the text whose pieces do not depend on what stands around them; an added token is a chunk."""
        if self.split_added and any(a in text for a in self.added):
            return [c for part in self.split_added.split(text) if part for c in ([part] if part in self.added else self._cut(part))]
        return self._cut(text)

    def _cut(self, text: str) -> list[str]:
        if self.runs.search(text):
            return self.pieces.findall(text)
        first, *rest = text.split(" ")
        out = [" " + c for c in rest]
        return [first, *out] if first else out

    def learn_chunks(self, chunks: list[str]) -> dict[str, tuple[bytes, str]]:
        """Ids (as bytes) and their decimal text for chunks that are not in the cache; pieces have a cache of their own."""
        plain = [c for c in chunks if c not in self.added]
        cuts = list(map(self.pieces.findall, plain))
        known = self.piece_cache
        fresh = list(set().union(*cuts) - known.keys()) if cuts else []
        flat, ends = self.merge([p.encode("utf-8", "surrogatepass") for p in fresh])
        raw, text, width = flat.astype(self.wide).tobytes(), list(map(str, flat.tolist())), np.dtype(self.wide).itemsize
        ends = ends.tolist()
        made = {p: (raw[width * a : width * b], ",".join(text[a:b])) for p, a, b in zip(fresh, [0, *ends], ends)}
        get = known.get
        out = {c: (np.array([i], self.wide).tobytes(), str(i)) for c in chunks if (i := self.added.get(c)) is not None}
        for c, ps in zip(plain, cuts):
            got = [get(p) or made[p] for p in ps]
            out[c] = got[0] if len(got) == 1 else (b"".join([g[0] for g in got]), ",".join([g[1] for g in got]))
        if len(known) < _CACHE:
            known.update(made)
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text: its ids as little-endian unsigned integers, and as decimals joined by commas."""
        cache = self.cache
        for at in range(0, len(texts), 1024):
            cuts = [self.cut(t) for t in texts[at : at + 1024]]
            fresh = set().union(*cuts) - cache.keys() if cuts else set()
            extra = self.learn_chunks(list(fresh)) if fresh else {}
            if len(cache) < _CACHE:
                cache.update(extra)
                extra = {}
            get = cache.get
            for chunks in cuts:
                pairs = [get(c) or extra[c] for c in chunks] if extra else list(map(cache.__getitem__, chunks))
                yield b"".join([p[0] for p in pairs]), ",".join([p[1] for p in pairs])

    def decode(self, ids: np.ndarray) -> str:
        size = self.length[ids]
        total = int(size.sum())
        ends = np.cumsum(size)
        where = np.repeat(self.offset[ids] - (ends - size), size) + np.arange(total)
        return self.bytes[where].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBPE:
    return ByteBPE(path)


def _encoder(path: str, texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n, ids_sha, back_sha, ids_out, back_out = [], [], [], [], []
                for raw, line in bpe.encode_batch(texts):
                    ids = np.frombuffer(raw, bpe.wide)
                    back = bpe.decode(ids)
                    n.append(len(ids))
                    if texts_too:
                        ids_out.append(ids.astype(np.int32))
                        back_out.append(back)
                    ids_sha.append(hashlib.sha256(line.encode()).hexdigest())
                    back_sha.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if texts_too:
                    columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(back_out, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.record_batch(columns, names=names)

    return run


def encoded(docs: DataFrame, path: str, texts_too: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with texts_too the ids and the decoded text."""
    long_rows(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts_too
    return docs.select("doc_id", "text").mapInArrow(_encoder(path, texts_too), schema)
