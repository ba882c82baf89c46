"""The corpus operators against brute force, the libraries they follow, and exact round trips; edge cases of every operator."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafwork.llm import bpe, common, idcodec, language, linededup, mixing, quality, shards, simhash, spotsigs, telephony
from leafwork.llm.queries import tokenizer_path

LONG = "the long word again. " * 12_000
ROWS = [
    (1, "The cat sat on the mat and looked at the very old dog by the door of the house.", "en", "a"),
    (2, "The cat sat on the mat and looked at the very old dog by the door of the house.", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, "Die Katze sitzt auf der Matte und der Hund liegt vor der Tür.\nÄpfel und Öl.", "de", None),
    (5, "Die Katze sitzt auf der Matte und der Hund liegt vor der Tür.\nÄpfel und Öl.", "de", None),
    (6, LONG, "en", "c"),
    (7, " \t\n ", None, "b"),
    (8, "123 456 !!!   x<|endoftext|>y İΣ é \U0001f600", "xx", "\U00010400"),
    (None, "no id here, and the same line of seven words stands here twice.\nno id here, and the same line of seven words stands here twice.", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, "y") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# -- 1 ------------------------------------------------------------------------


def test_quality(spark, docs, small, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality.scored(whole, labels).join(labels.groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id").where("held_out").toPandas()
    assert out.score.between(0, 1).all()
    good, bad = out[out.q == 1].score, out[out.q == 0].score
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    odd = quality.scored(docs, labels.where("doc_id < 0")).collect()
    assert len(odd) == len(ROWS) and {r["score"] for r in odd} == {0.5}
    assert quality.scored(empty, labels).count() == 0


# -- 2 ------------------------------------------------------------------------


def test_huffman_round_trip():
    draw = np.random.default_rng(1)
    for n, size in ((1, 5), (2, 700), (300, 5000), (40_000, 100_000)):
        ids = np.minimum(draw.geometric(4 / n if n > 4 else 0.5, size) - 1, n - 1)
        lengths = idcodec.code_lengths(np.bincount(ids, minlength=n))
        assert sum(2.0 ** -int(x) for x in lengths if x) <= 1 and lengths.max() <= idcodec.LIMIT
        code = idcodec.Code(lengths)
        raw = idcodec.block(code, np.array([7, 9]), np.array([size - 1, 1]), ids)
        doc_ids, counts, back = idcodec.read_block(code, raw)
        assert doc_ids.tolist() == [7, 9] and counts.tolist() == [size - 1, 1] and (back == ids).all()
    assert idcodec.code_lengths(np.zeros(3)).tolist() == [0, 0, 0]


def test_limited_lengths_are_best():
    counts = np.array([1, 1, 2, 3, 5, 8, 13])
    best = min(sum(c * x for c, x in zip(counts, ls)) for ls in itertools.product(range(1, 5), repeat=7) if sum(2.0**-x for x in ls) <= 1)
    assert int((idcodec.code_lengths(counts, 4) * counts).sum()) == best


def test_archive(docs, empty):
    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = sorted(idcodec.write(docs, path, block_ids=50).read().collect(), key=lambda r: r["start"])
    start, want = 0, []
    for d, text, *_ in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert idcodec.write(empty, path).read().count() == 0


def test_chunk_table_is_bounded_and_exact(monkeypatch):
    """Ids are the library's while the tables are empty, filling and full; chunks differ by NUL bytes or beyond 8 and 16 bytes."""
    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    draw = np.random.default_rng(5)
    words = [*("".join(draw.choice(list("abcdeÄé.'1"), draw.integers(1, 24))) for _ in range(300)), "a", "a\0", "a\0\0", "abcdefgh", "abcdefgh\0", "abcdefghijklmnop", "abcdefghijklmnopq", "日本語日本語日本語"]
    monkeypatch.setattr(idcodec, "_CHUNKS", 150)
    monkeypatch.setattr(idcodec, "_CACHE", 40)
    tok = idcodec.Words(path)
    for _ in range(6):
        texts = [" ".join(draw.choice(words, n)) for n in (0, 1, 90, 2, 60)] + ["", " \n ", None, "a\0 a"]
        for _, raw, at in common.pieces(pa.array(texts)):
            ids, n = tok.ids(raw, at)
            assert np.split(ids, np.cumsum(n))[-1].size == 0
            assert [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert tok.chunks.used <= 150 and len(tok.cores) <= 400


# -- 3 ------------------------------------------------------------------------


def test_differencing():
    draw = np.random.default_rng(2)
    sizes = draw.integers(1, 5000, 400).tolist()
    place = shards.difference([[s] + [0] * 7 for s in sizes], 8)[:, 0]
    sums = np.bincount(place, sizes, 8)
    assert sums.max() - sums.min() <= 3
    assert shards.difference([[8], [7], [6], [5], [4]] and [[x, 0] for x in (8, 7, 6, 5, 4)], 2)[:, 0].tolist().count(0) in (2, 3)


def test_sharded(docs, empty):
    got = shards.sharded(docs).collect()
    assert len(got) == len(ROWS)
    of = {}
    for r in got:
        of.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in of.values())
    texts = {}
    for r in got:
        texts.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in texts.values())
    assert shards.sharded(empty).count() == 0


# -- 4 ------------------------------------------------------------------------


def test_code_lengths_by_hand():
    trees = language.Trees({"a": ["abab abba", "aab"], "b": ["xyz xyx", "ab"]})
    for m, name in enumerate(trees.languages):
        counts = {}
        for text in {"a": ["abab abba", "aab"], "b": ["xyz xyx", "ab"]}[name]:
            raw = b"\n\n\n" + text.encode()
            for i, k in itertools.product(range(3, len(raw)), range(4)):
                c = counts.setdefault(raw[i - k : i], {})
                c[raw[i]] = c.get(raw[i], 0) + 1

        def cost(context, byte):
            c = counts.get(context, {})
            n, d = sum(c.values()), len(c)
            if byte in c:
                return -np.log2(c[byte] / (n + d))
            down = -np.log2(d / (n + d)) if n else 0.0
            return down + (cost(context[1:], byte) if context else 8.0)

        for text in ("abba", "xyzq", "é ab", "z"):
            raw = b"\n\n\n" + text.encode()
            want = sum(cost(raw[i - 3 : i], raw[i]) for i in range(3, len(raw)))
            own = np.frombuffer(text.encode(), np.uint8)
            got = trees.lengths(own, np.array([0, len(own)]))[0, m] / language.UNIT
            assert abs(got - want) < 1e-3


def test_language(docs, small, empty):
    got = language.identified(small).join(small.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.9
    odd = {r["doc_id"]: r for r in language.identified(docs).collect()}
    assert odd[3]["lang_pred"] == odd[4]["lang_pred"] == odd[7]["lang_pred"] == "und" and odd[3]["score"] == 0
    assert language.identified(empty).count() == 0
    kept = language.keep_known(docs, language.learn(docs))
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 5, 6, 8]


def test_language_stage_rejects_noise(spark, small):
    """Noise, keys, numbers and a script that was not learned go; prose and short texts stay; a null lang is filled."""
    draw = np.random.default_rng(3)
    letters = lambda n: "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), n))
    junk = [letters(400), " ".join(letters(9) for _ in range(50)), "4" * 30 + letters(200), "Съешь же ещё этих мягких французских булок " * 3, "1234 567", ""]
    d = small.select("doc_id", "text", "lang").where("length(text) > 40").unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate([*junk, "Hey."])], "doc_id long, text string, lang string"))
    nothing = d.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    got = {r["doc_id"]: r["lang"] for r in language.keep_known(nothing, language.learn(small)).collect()}
    assert min(got) == -7 and not set(range(-6, 0)) & set(got)
    want = {r["doc_id"]: r["lang"] for r in d.collect() if r["doc_id"] >= 0}
    kept = [i for i in want if i in got]
    assert len(kept) >= 0.99 * len(want) and np.mean([got[i] == want[i] for i in kept]) > 0.95


def test_language_sample_is_bounded(spark):
    rows = [(i, "abc def ghi " * (1 + i % 50), "en") for i in range(300)] + [(1000, "q" * 5000, "en"), (1001, "nur ein Text", "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    t = language.learn(d, most_bytes=4000)
    assert t.languages == ["de", "en"] and t.symbol[ord("q")] == 0


# -- 5 ------------------------------------------------------------------------


def _sigs(text):
    import regex

    words, anchor, at = [], True, []
    for line_no, line in enumerate(regex.split(r"[\n\r]", text.lower())):
        anchor = True
        for w in regex.findall(r"[\p{L}\p{N}\p{M}]+", line):
            if w in spotsigs.COMMON:
                anchor = True
            else:
                if anchor:
                    at.append(len(words))
                words.append(w)
                anchor = False
    return {" ".join(words[i : i + 3]) for i in at}


def test_spotsigs(spark, docs, empty):
    texts = [r[1] for r in ROWS if r[1]]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.size(spotsigs.signatures(F.col("t"))).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == {t: len(_sigs(t)) for t in texts}
    rows = {r["doc_id"]: r for r in spotsigs.edited(docs).collect()}
    order = sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in ROWS})
    for (d, text), (_, after) in zip(order, order[1:] + order[:1]):
        k = len(text) // 4
        new = text[: len(text) - k] + after[:k]
        a, b, c = _sigs(text), _sigs(new), _sigs(after)
        r = rows[None if d == -1 else d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
        assert r["near_next"] == pytest.approx(len(a & c) / len(a | c) if a | c else 1)
    assert len(rows) == len({r[0] for r in ROWS}) and spotsigs.edited(docs).count() == len(ROWS)
    assert spotsigs.edited(empty).count() == 0


def test_spotsigs_pairs(spark, small):
    pairs, members = spotsigs.near_pairs(small)
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    sets = {r["fp"]: set(r["sigs"]) for r in small.select(spotsigs.signatures(F.col("text")).alias("sigs")).withColumn("fp", F.sha2(F.to_json("sigs"), 256)).collect() if r["sigs"]}
    want = {tuple(sorted(p)) for p in itertools.combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) >= 0.8}
    assert got == want and members.count() == small.count()


# -- 6 ------------------------------------------------------------------------


def test_golay():
    draw = np.random.default_rng(4)
    words = draw.integers(0, 1 << 12, 50)
    codes = np.array([int(w) << 11 | simhash._remainder(int(w) << 11) for w in words])
    assert min(bin(int(a) ^ int(b)).count("1") for a, b in itertools.combinations(set(codes.tolist()), 2)) >= 7
    for code, w in zip(codes, words):
        for bits in itertools.combinations(range(23), 3):
            assert simhash.decode(np.array([code ^ sum(1 << b for b in bits)]))[0] == w


def test_links_find_all(spark):
    draw = np.random.default_rng(5)
    fps = []
    for _ in range(60):
        f = int(draw.integers(0, 1 << 63))
        fps.append(f)
        for _ in range(int(draw.integers(0, 40))):
            f = fps[-1] if draw.random() < 0.5 else f
            for b in draw.choice(64, int(draw.integers(1, 6)), replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    fps = sorted({f & ((1 << 64) - 1) for f in fps} | {0, 7, 1 << 63})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(b)] = find(a)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    nodes = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    mine, want = {}, {}
    for f in fps:
        mine.setdefault(nodes.get(f, f), set()).add(f)
        want.setdefault(find(f), set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_simhash(docs, empty):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert got[3]["fingerprint"] == "0" * 16 == got[4]["fingerprint"] and got[4]["component_id"] == got[7]["component_id"] == 3
    assert got[2]["component_id"] == 1 and got[5]["component_id"] == 5
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 8]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


# -- 7 ------------------------------------------------------------------------


def test_fit():
    draw = np.random.default_rng(6)
    for _ in range(40):
        lengths = np.unique(draw.integers(0, 60, 12))
        counts = draw.integers(1, 5, len(lengths))
        budget = int(draw.integers(0, (lengths * counts).sum() + 1))
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        assert abs(budget - int((lengths * take).sum())) <= max(3, min(abs(budget - s) for s in sums))


def test_targets():
    got = mixing.targets({"b": 100, "a": 10, None: 100})
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(315) and got["b"] == 2 * got[None] * 1.0


def test_mixed(spark, docs, empty):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in got)
    sums = {}
    for r in mixing.mixed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        s = sums.setdefault(r["source"], [r["target"], 0])
        s[1] += r["taken"]
    assert all(abs(t - k) <= 1 for t, k in sums.values())
    assert sorted(map(str, mixing.mixed(docs.repartition(5)).collect())) == sorted(map(str, got))
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mixed(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


# -- 8 ------------------------------------------------------------------------


def test_telephony_tables():
    assert telephony.MU_TABLE[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.A_TABLE[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def test_adpcm_by_sample():
    raw = np.random.default_rng(7).integers(0, 256, 4 * 192).astype(np.uint8)
    for block, got in zip(raw.reshape(-1, 192), telephony.adpcm(raw)):
        value, index = int(block[:2].copy().view("<i2")[0]), min(int(block[2]), 88)
        out = [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + (step >> 2 if code & 1 else 0) + (step >> 1 if code & 2 else 0) + (step if code & 4 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                out.append(value)
        assert out == got.tolist()


def test_media(docs, empty):
    media = telephony.media_of(docs)
    got = {r["doc_id"]: r for r in telephony.described(media).collect()}
    for d, text, *_ in ROWS:
        raw = (text or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(telephony.wav(payload)).hexdigest()
    assert got[1]["feature"] == got[2]["feature"]
    pcm = telephony.pcm_of(media.where("doc_id = 1")).first()["pcm"]
    kind, rate, samples = telephony.unwav(bytes(pcm))
    assert (kind, rate) == (1, 16_000) and np.frombuffer(samples, "<i2")[::2].tolist() == telephony.MU_TABLE[np.frombuffer(payload_for(1), np.uint8)].tolist()
    assert telephony.described(telephony.media_of(empty)).count() == 0
    assert telephony.expand(None).size == 0


def payload_for(doc):
    return telephony.payload_of(next(r[1] for r in ROWS if r[0] == doc))[1]


# -- 9 ------------------------------------------------------------------------


def test_repeats(spark, docs, empty):
    passage = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen!"
    rows = [(1, f"intro of the first text here {passage} and an end that differs"), (2, f"something else was before it. {passage} Tail of two."), (3, "a b c\na b c"), (4, "This whole LINE has seven words indeed."), (5, "x\nthis  whole line has seven words indeed.\ny")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], rows[r["doc_id"] - 1][1][r["start_char"] : r["end_char"]].strip(), r["first_doc_id"]) for r in linededup.repeats(d).collect()}
    assert got == {(2, "Eight nine ten eleven twelve thirteen fourteen!", 1), (5, "this  whole line has seven words indeed.", 4)}
    new = {r["doc_id"]: r["text"] for r in linededup.without_repeats(d).collect()}
    assert new[1] == rows[0][1] and new[3] == rows[2][1] and new[5] == "x\ny"
    out = linededup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert {r["text"] for r in out.where("doc_id = 2").collect()} == {""} and out.where("doc_id = 3").first()["text"] is None
    assert linededup.repeats(empty).count() == 0 and linededup.without_repeats(empty).count() == 0


_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?![ \t\r\f\v\n.!?]|\Z)[^.!?\n]*)*[.!?]*[ \t\r\f\v]*")


def _plain_units(text, least=6):
    """(kind, line, start, stop, normalised words) of every unit, cut by a pattern and by loops."""
    norm = lambda x: " ".join(w.decode() for w in x.lower().encode().split())
    at, atoms, out = 0, [], []
    for line in text.split("\n"):
        if len(norm(line).split(" ")) >= least and norm(line):
            out.append(("line", at, at, at + len(line), norm(line)))
        spans = [m.span() for m in _SENTENCE.finditer(line) if m.end() > m.start()] if norm(line) else []
        for a, b in spans if len(spans) > 1 else []:
            if norm(line[a:b]).count(" ") >= least - 1:
                out.append(("sentence", at, at + a, at + b, norm(line[a:b])))
        atoms += [(at + a, at + b, norm(line[a:b])) for a, b in spans] if len(spans) > 1 else [(at, at + len(line), norm(line))] if norm(line) else []
        at += len(line) + 1
    sizes, pairs = [x.count(" ") + 1 for _, _, x in atoms], set()
    for i, n in enumerate(sizes):
        for step in (1, -1) if n < least else ():
            j, total = i, n
            while total < least and 0 <= j + step < len(sizes):
                j += step
                total += sizes[j]
            if total >= least:
                pairs.add((min(i, j), max(i, j)))
    out += [("run", None, atoms[i][0], atoms[j][1], " ".join(x for _, _, x in atoms[i : j + 1])) for i, j in pairs]
    spans = [m.span() for m in re.finditer(r"[^ \t-\r]+", text)]
    if len(spans) >= linededup.PASSAGE:
        low = text.lower().encode().split()
        h = np.array([xxhash.xxh3_128_intdigest(w) >> 64 for w in low], np.uint64)
        out += [("window", None, spans[a][0], spans[b - 1][1], " ".join(w.decode() for w in low[a:b])) for a, b in zip(*(x.tolist() for x in linededup.windows(h)))]
    return out


def test_units_by_pattern(small):
    texts = [r["text"] for r in small.collect()] + [r[1] for r in ROWS] + [" a. b? c ... d.e f! \t\n\n . x\r\n y z \x1c w. ", "Eins zwei drei vier fünf sechs \nsieben. Acht!  ", "İ a b c d e f. g"]
    for text in texts:
        u = linededup.units(text or "")
        got = list(zip(*(x.tolist() for x in (u.start, u.stop, u.words)))) if u else []
        want = [(start, stop, words.count(" ") + 1) for _, _, start, stop, words in _plain_units(text or "")]
        assert sorted(got) == sorted(want)
        if u:
            assert {(s, e) for line, s, e in zip(u.line, u.start, u.stop) if line >= 0} == {(s, e) for kind, _, s, e, _ in _plain_units(text) if kind in ("line", "sentence")}


def test_repeats_brute_force(small, spark):
    """The same units go as by plain cutting and a dictionary, whatever the batches are."""
    docs = small.unionByName(spark.createDataFrame([(10_000 + i, "The same line stands in very many texts.\nnumber %d is all that differs" % (i % 40)) for i in range(300)], "doc_id long, text string"), allowMissingColumns=True)
    first, want = {}, set()
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        whole = {}
        for kind, line, start, stop, words in sorted(_plain_units(r["text"] or ""), key=lambda x: x[2]):
            if first.setdefault(words, (r["doc_id"], start)) != (r["doc_id"], start):
                whole.setdefault(line, set()).add((kind, start, stop, words))
        for line, found in whole.items():
            covered = line is not None and any(kind == "line" for kind, *_ in found)
            want |= {(r["doc_id"], start, stop, *first[words]) for kind, start, stop, words in found if kind != "sentence" or not covered}
    for d, rows in ((docs.coalesce(1), 2000), (docs.repartition(7), 37)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        got = [(r["doc_id"], r["start_char"], r["end_char"], r["first_doc_id"], r["first_start"]) for r in linededup.repeats(d).collect()]
        assert set(got) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)


def test_repeats_of_short_units(spark):
    """Passages of over 50 words in lines or sentences of up to five words are removed whole, whatever stands around them."""
    draw = np.random.default_rng(6)
    part = lambda tag: [" ".join(f"{tag}{i}{j}" for j in range(draw.integers(1, 6))) for i in range(25)]
    verse, talk = part("v"), [x + "." for x in part("t")]
    assert all(sum(len(x.split()) for x in p) > 50 for p in (verse, talk))
    mixed = ["Yes.", "This sentence has more than six words.", "No.", "Why not."]
    rows = [
        (1, "\n".join(["p q", *verse, "r"])),
        (2, "\n".join(["other", "s t u", *verse, "last one here"])),
        (3, "Before it a. " + " ".join(talk) + " After it b."),
        (4, "Begin c. " + " ".join(talk) + " End d."),
        (5, "Before. " + " ".join(mixed) + " After."),
        (6, "Here. " + " ".join(mixed) + " There."),
        (7, "p q\nzz\nr"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    new = {r["doc_id"]: r["text"] for r in linededup.without_repeats(d).collect()}
    assert [new[i] for i in (1, 3, 5, 7)] == [rows[i - 1][1] for i in (1, 3, 5, 7)]
    assert new[2].split() == "other s t u last one here".split()
    assert new[4].split() == "Begin c. End d.".split() and new[6].split() == "Here. There.".split()


def test_repeats_of_passages_without_sentences(spark):
    """A passage of 51 words inside one sentence is found wherever it stands; at most 13 words stay at its start and 26 at its end."""
    draw = np.random.default_rng(7)
    rows, passages = [], []
    for i in range(60):
        passage = [f"p{i}x{x}" for x in draw.integers(0, 40, 51)]
        for side in (0, 1):
            head, tail = ([f"{tag}{i}{side}{x}" for x in range(draw.integers(0, 40))] for tag in "ht")
            rows.append((2 * i + side, " ".join(head + passage + tail)))
        passages.append(passage)
    new = {r["doc_id"]: r["text"].split() for r in linededup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, passage in enumerate(passages):
        assert new[2 * i] == rows[2 * i][1].split()
        left = [w for w in new[2 * i + 1] if w.startswith("p")]
        assert any(left == passage[:a] + passage[len(passage) - len(left) + a :] and a <= 13 and len(left) - a <= 26 for a in range(len(left) + 1))


# -- 10 -----------------------------------------------------------------------


def test_bpe(docs, small, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    own = bpe.vocabulary(path)
    texts = [r[1] or "" for r in ROWS] + ["  a  b\n\n c \t d", "aaaa aaaaaaa 12 's don't", " lead", "trail ", "q\x1c\x85 r", "a  b"] + [r["text"] for r in small.collect()]
    for (raw, line), e in zip(own.encode_batch(texts), t.encode_batch(texts, add_special_tokens=False)):
        ids = np.frombuffer(raw, own.wide)
        assert ids.tolist() == e.ids and line == ",".join(map(str, e.ids)) and own.decode(ids) == t.decode(e.ids, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in bpe.encoded(docs, path, texts_too=True).collect()}
    assert all(got[d]["decoded"] == (text or "") for d, text, *_ in ROWS)
    assert own.decode(np.array([own.of_byte[0xC3]])) == "�"
    assert bpe.encoded(empty, path).count() == 0


# -- the pipeline -------------------------------------------------------------


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        names, at = at.columns, common.written(stage(spark, at, folder))
        assert at.columns == names
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == at.count()


def test_fit_takes_a_document_longer_than_the_window():
    """A document more than a window beyond what is left is taken where that comes nearer to the budget, and only there."""
    fit = lambda lengths, counts, budget: mixing.fit(np.array(lengths), np.array(counts), budget).tolist()
    assert fit([300_000], [1], 200_000) == [1] and fit([300_000], [1], 140_000) == [0]
    assert fit([10, 300_000], [1000, 1], 250_000) == [0, 1] and fit([10, 300_000], [1000, 1], 100_000) == [1000, 0]
    assert fit([10, 200_000, 300_000], [1000, 1, 1], 305_000) == [500, 0, 1]


def test_tree_edges_only(spark):
    """Edges of a group grow with its members, not with their square, and connect what is connected."""
    draw = np.random.default_rng(11)
    base, per_node = int(draw.integers(0, 1 << 62)), []
    for n in (200, 800, 3200):
        fps = {base}
        while len(fps) < n:
            f = base
            for b in draw.choice(60, int(draw.integers(1, 4)), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
        edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
        per_node.append(edges.count() / n)
        assert {r["root"] for r in simhash.components(edges).collect()} == {min(fps)}
    assert max(per_node) <= 29


def test_forest():
    draw = np.random.default_rng(12)
    for n in (0, 1, 5, 60):
        a, b = draw.integers(0, 80, (2, n))
        root = list(range(80))
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = min(root[x], root[y]), max(root[x], root[y])
            root = [x if r == y else r for r in root]
        got = dict(zip(*(x.tolist() for x in simhash.forest(a, b)[::-1])))
        assert got == {i: r for i, r in enumerate(root) if r != i}
    chain = np.arange(5000)
    roots, nodes = simhash.forest(chain[:-1], chain[1:])
    assert (roots == 0).all() and nodes.tolist() == list(range(1, 5000))


def test_fingerprint_bit_by_bit():
    for text in [*(r[1] for r in ROWS[:6]), "A b C d\u00c4 e\x1cf", "one", "a a a a a a a"]:
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        h = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))] if words else []
        want = sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))
        assert int.from_bytes(simhash.fingerprint(text), "big") == want


def test_keep_one_loses_no_text(spark):
    """Texts with a null doc_id, and different texts that share one, stay; copies of them go."""
    rows = [(None, "first text with some words in it"), (None, "second text about something else here"), (None, "first text with some words in it"), (7, "third text which is not like others"), (7, "fourth one is again quite different"), (8, "third text which is not like others"), (None, None), (9, "fourth one is again quite different")]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n long")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in simhash.keep_one(d).collect())
    assert got == sorted((i or 0, t or "") for i, t in {r for r in rows if r[0] not in (8, 9)})


def test_near_duplicate_stage_similarity(spark):
    """The stage takes near copies of five-word similarity 0.8 and more, leaves those below, and links by similarity alone."""
    draw = np.random.default_rng(4)
    rows, wanted, below = [], 0, 0
    while wanted < 120:
        words = [f"w{x}" for x in draw.integers(0, 5000, int(draw.integers(100, 600)))]
        other = [f"n{draw.integers(1 << 40)}" if draw.random() < 0.026 else w for w in words]
        sets = [set(zip(*(w[i:] for i in range(5)))) for w in (words, other)]
        s = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        if 0.8 <= s < 0.9 and wanted < 120 or 0.6 < s < 0.79 and below < 40:
            wanted, below = wanted + (s >= 0.8), below + (s < 0.8)
            rows += [(2 * len(rows), " ".join(words), s >= 0.8), (2 * len(rows) + 1, " ".join(other), s >= 0.8)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(d).select("doc_id").collect()}
    assert kept >= {i for i, _, _ in rows[::2]} | {i for i, _, near in rows[1::2] if not near}
    assert sum(i not in kept for i, _, near in rows[1::2] if near) >= 0.95 * wanted


def test_classes_bound_the_similarity():
    draw = np.random.default_rng(8)
    for n in (0, 1, 30, 300, 5000):
        a = np.unique(draw.integers(0, 1 << 32, n).astype(np.uint32))
        b = np.unique(np.concatenate([a[: int(n * draw.random())], draw.integers(0, 1 << 32, n // 3).astype(np.uint32)]))
        bound = simhash.most_similar(*(np.array([simhash.classes_of(x)]) for x in (a, b)))[0]
        assert bound >= simhash.similarity(a, b)
        assert simhash.classes_of(a) == -1 if n == 5000 else bound == (np.minimum(*(np.bincount(x & 7, minlength=8) for x in (a, b))).sum() / max(1, np.maximum(*(np.bincount(x & 7, minlength=8) for x in (a, b))).sum()) if n else 1.0)


def test_near_duplicate_stage_large_group(spark):
    """A large group of near copies, copies in other case and space, empty and null texts: one of each stays."""
    draw = np.random.default_rng(5)
    base = [f"w{x}" for x in draw.integers(0, 5000, 300)]
    texts = [" ".join(f"n{i}" if j == i else w for j, w in enumerate(base)) for i in range(300)]
    texts += ["one Two", " ONE  two", "", None, "three"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(d).collect()) == [0, 300, 302, 304]


def test_long_run_keeps_what_its_root_is_not_like():
    """In a run longer than `small`, members that the root's classes exclude are still held against each other."""
    f = np.zeros(12, np.uint64)
    sets = [np.arange(0, 800, 8, dtype=np.uint32)] + [np.arange(1, 801, 8, dtype=np.uint32)] * 11
    classes = np.array([simhash.classes_of(x) for x in sets])
    x, y = simhash.run_pairs(f, classes, 14, 0.8)
    assert 0 not in x and set(zip(x, y)) == {(1, j) for j in range(2, 12)}


def test_no_candidate_of_a_long_run_is_left_out(spark):
    """Groups in which most are like a few others only: the components are those of all candidates that are similar enough."""
    draw = np.random.default_rng(6)
    texts = []
    for group in range(3):
        base = [f"w{x}" for x in draw.integers(0, 5000, 300)]
        for i in range(150):
            words = list(base)
            for j in draw.choice(300, i % 3 if i < 9 else 4 + i % 4, replace=False):
                words[j] = f"{group}n{i}-{j}"
            texts.append(" ".join(words))
    sets = [simhash.shingle_set(t) for t in texts]
    fps = np.stack([np.frombuffer(simhash.fingerprints_of(t, 4), ">u8").astype(np.uint64) for t in texts])
    runs, a, b = {}, [], []
    for k in range(4):
        for row, key in zip(*simhash.keys_of(fps[:, k])):
            runs.setdefault((k, int(key)), []).append(int(row))
    pairs = {(k, *sorted(p)) for (k, _), rows in runs.items() for p in itertools.combinations(rows, 2)}
    for k, x, y in pairs:
        if np.bitwise_count(fps[x, k] ^ fps[y, k]) <= 14 and simhash.similarity(sets[x], sets[y]) >= 0.8:
            a.append(x), b.append(y)
    roots, nodes = simhash.forest(np.array(a), np.array(b))
    wanted = dict(enumerate(range(len(texts)))) | dict(zip(nodes.tolist(), roots.tolist()))
    assert max(map(len, runs.values())) > 64
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_components(d).collect()} == wanted


def test_pairs_across_by_brute_force():
    """All pairs between components that the counts allow; with a limit the first of each member, and a mark where there are more."""
    draw = np.random.default_rng(7)
    base = draw.integers(0, 1 << 32, 200).astype(np.uint32)
    sets = [np.unique(np.concatenate([base[draw.random(200) < 0.97], draw.integers(0, 1 << 32, 8).astype(np.uint32)])) for _ in range(40)] + [np.zeros(0, np.uint32)] * 2
    f = np.uint64(1 << 40) ^ (draw.integers(0, 1 << 18, 42).astype(np.uint64))
    classes, wide, roots = np.array([simhash.classes_of(x) for x in sets]), np.stack([simhash.wide_classes_of(x) for x in sets]), draw.integers(0, 4, 42)
    fit = {(i, j) for i, j in itertools.combinations(range(42), 2) if roots[i] != roots[j] and np.bitwise_count(f[i] ^ f[j]) <= 9 and min(simhash.most_similar(classes[i : i + 1], classes[j : j + 1])[0], simhash.most_similar_wide(wide[i], wide[j : j + 1])[0]) >= 0.8}
    x, y, more = simhash.pairs_across(f, classes, wide, roots, 9, 0.8, 1000)
    assert sorted((min(p), max(p)) for p in zip(x.tolist(), y.tolist())) == sorted(fit) and fit and not more.any()
    x, y, more = simhash.pairs_across(f, classes, wide, roots, 9, 0.8, 2)
    assert {(min(p), max(p)) for p in zip(x.tolist(), y.tolist())} < fit and more.any() and np.bincount(x).max() == 2
    assert not len(simhash.pairs_across(f, classes, wide, np.zeros(42, int), 9, 0.8, 1)[0])
    for i, j in itertools.combinations(range(42), 2):
        assert simhash.most_similar_wide(wide[i], wide[j : j + 1])[0] >= simhash.similarity(sets[i], sets[j])


def test_large_group_is_joined_once_a_text(spark, monkeypatch):
    """A text in many runs meets its component, its set and its first document in one row each: no join on nodes gives more rows than there are texts."""
    draw = np.random.default_rng(9)
    base = [f"w{x}" for x in draw.integers(0, 5000, 300)]
    texts = []
    for i in range(160):
        words = list(base)
        for j in draw.choice(300, 2 + i % 6, replace=False):
            words[j] = f"n{i}-{j}"
        texts.append(" ".join(words))
    d, made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), []
    plain, across = type(d).join, simhash._linked_across

    def join(self, other, on=None, how=None):
        out = plain(self, other, on, how)
        if isinstance(on, str) and on == "node":
            made.append(out.count())
        return out

    monkeypatch.setattr(type(d), "join", join)
    monkeypatch.setattr(simhash, "_linked_across", lambda *a: made.append("across") or across(*a))
    simhash.keep_one(d)
    assert "across" in made and max(x for x in made if x != "across") <= len(texts)


def test_members_spread_over_their_runs():
    """Each member stands in each of its runs with its own columns, in sliced batches and over several pieces as well."""
    runs = [[{"key": 1000 * i + j, "fp": i - j} for j in range(i % 7 * 300)] for i in range(12)]
    kinds = [("node", pa.int64()), ("classes", pa.int64()), ("root", pa.int64()), ("wide", pa.binary()), ("runs", pa.list_(pa.struct([("key", pa.int32()), ("fp", pa.int64())])))]
    batch = pa.RecordBatch.from_pylist([{"node": i, "classes": -i, "root": i // 2, "wide": bytes([i]), "runs": x} for i, x in enumerate(runs)], pa.schema(kinds))
    got = [r for b in simhash._spread(iter([batch.slice(0, 0), batch.slice(2, 9), batch.slice(11)])) for r in b.to_pylist()]
    assert len(got) > 4096 and got == [{**run, "node": i, "classes": -i, "root": i // 2, "wide": bytes([i])} for i in range(2, 12) for run in runs[i]]
