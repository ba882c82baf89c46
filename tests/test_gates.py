"""Grounding of values against a brute-force version; no empty branch in the fixtures of the gates."""

from difflib import SequenceMatcher

from leafwork.plans.registry import QUERIES
from leafwork.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def test_fuzzy_find_bbox(spark):
    pages = {}
    for r in sorted(X.blocks(spark, SF).collect(), key=lambda r: (r.doc_id, r.seq)):
        pages.setdefault(r.doc_id, []).append(r)
    found, how = QUERIES["fuzzy_find_bbox"](spark, SF).collect(), set()
    assert len(found) == sum(1 for d, rs in pages.items() if len(rs) > d % 2)
    for r in found:
        page = pages[r.doc_id]
        at = next((b for b in page if r.value in b.text.lower().strip()), None)
        how.add(r.how)
        if at is None:
            ratios = [SequenceMatcher(None, r.value, b.text.lower().strip()).ratio() for b in page]
            at = page[ratios.index(max(ratios))] if max(ratios) > 0.7 else None
        assert (r.seq, r.x0, r.y1) == ((at.seq, at.x0, at.y1) if at else (None, None, None))
    assert how == {"held", "alike"}


def test_branches(spark):
    assert {r.degrees for r in QUERIES["orientation"](spark, SF).select("degrees").distinct().collect()} == {0.0, 90.0}
    assert QUERIES["form_check"](spark, SF).where("is_form").count() > 0 < QUERIES["form_check"](spark, SF).where("not is_form").count()
    assert {r.form for r in QUERIES["form_final"](spark, SF).select("form").distinct().collect()} == {"cms1500", "ub04", "ncpdp", "generic"}
    assert QUERIES["blank_row_segments"](spark, SF).groupBy("doc_id", "seq").count().where("count < 2").count() == 0
