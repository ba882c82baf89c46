"""Rules on literal rows: validators, text, layout, assignment, streaming."""

import itertools
import json
import random

import numpy as np
from pyspark.sql import functions as F

from leafwork.functions import text as T
from leafwork.functions import validate as V
from leafwork.operators import layout as L
from leafwork.streaming import corrections


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("o")).first()["o"]


def test_validators(spark):
    check = lambda k, v: one(spark, lambda c: V.first_family(k, c), v)
    assert check("date", "1/2/49")["normalized"] == "01/02/2049"
    assert check("date", "1/2/50")["normalized"] == "01/02/1950"
    assert check("date", "13/2/50")["reason"] == "format"
    assert check("icd", "a12.3")["normalized"] == "A12.3"
    assert not check("icd", "U07.1")["passed"]
    assert check("npi", "123")["reason"] == "length"
    assert not check("npi", "1234567893")["passed"]
    assert check("money", "1,000.5")["normalized"] == "$1,000.5"
    assert check("zip", None)["reason"] == "empty"
    assert check("nothing", "x")["reason"] == "unknown_validator"
    assert one(spark, lambda c: V.second_family("date", c), "1-2-50")["normalized"] == "01/02/2050"
    assert one(spark, lambda c: V.second_family("zip", c), "")["passed"]


def test_text(spark):
    assert one(spark, T.fix_hyphenation, "infor-\n mation of a- b") == "information of ab"
    assert one(spark, T.clean_text, "  a  100|\n\n\n\nb ") == "a 1OOl\n\nb"
    assert one(spark, T.ocr_repair, "3O5 , 12O\n\n x") == "305, 120\nx"
    assert one(spark, T.strip_labels_zone, "12345 MAIN ST") == "AIN ST"
    assert one(spark, T.guess_field_type, "AMOUNT PAID") == "member_id"


def test_assignment_is_least():
    draw = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 3), (2, 4), (4, 2)):
        cost = draw.random((n, m)) * 10
        mine = sum(cost[i, j] for i, j in L.assign(cost))
        short, long = (cost, m) if n <= m else (cost.T, n)
        assert abs(mine - min(sum(short[i, p[i]] for i in range(len(short))) for p in itertools.permutations(range(long), len(short)))) < 1e-9


def _page(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randrange(0, 2000, 50), r.randrange(0, 3000, 50)
        out.append(L.Block(i, r.choice(["text", "title", "table", "figure", "form"]), x, y, x + r.randrange(50, 900, 50), y + r.randrange(20, 400, 20), r.randrange(50, 100) / 100))
    return out


def test_layout_invariants():
    for seed in range(30):
        page = _page(20, seed)
        kept = L.nms(page)
        assert all(L.iou(a, b) <= 0.1 for a, b in itertools.combinations(kept, 2))
        assert sum(b.members for b in L.merge_overlapping(page)) == len(page)
        assert sum(b.members for b in L.merge_text_lines(page)) == len(page)
        assert sum(b.members for b in L.merge_fragments(page)) == len(page)
        assert len(L.resolve_overlaps(page)) == len(page)
        assert len(L.segment(page)) <= len(page)
    assert L.segment([]) == []


def test_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = [json.dumps({"block_id": "b", "source": s, "new_confidence": c}) for s, c in (("ocr", 0.4), ("ocr", 0.8), ("user", 1.0))] + ["no json"]
    (tmp_path / "log" / "a.json").write_text("\n".join(lines))
    q = corrections.figures(corrections.read_log(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("figures").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["source"]: (r["n"], round(r["mean_confidence"], 6), r["low_share"]) for r in spark.table("figures").collect()}
    assert got == {"ocr": (2, 0.6, 0.5), "user": (1, 1.0, 0.0)}
