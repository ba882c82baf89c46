"""Queries of form checks, page orientation, template columns, captions, blank rows, block filters and grounding."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from leafwork.functions import geometry as G
from leafwork.plans.registry import query
from leafwork.sources import fixtures as X

# -- forms ------------------------------------------------------------------------

#: Words of a page's head that tell the claim form (fixed values); more than 0.3 of them decide.
INDICATORS = ("cms-1500", "cms 1500", "health insurance claim", "approved by national uniform", "hcfa-1500")
_HEADS = ("HEALTH INSURANCE CLAIM FORM, Approved by National Uniform Claim Committee", "CMS-1500", "HCFA-1500 (health insurance claim)", "letter")
_NAMES = ("Scan_CMS1500_", "cms-1500 page ", "invoice ", "UB-04 ")

_SHARE = "(" + " + ".join(f"contains(t, '{w}')::INT" for w in INDICATORS) + f") / {len(INDICATORS)}.0::DOUBLE"


@query("form_check", f"SELECT o_orderkey, {_SHARE} AS score, {_SHARE} > 0.3::DOUBLE AS is_form FROM (SELECT o_orderkey, lower({X.pick_sql(_HEADS, 'o_orderkey % 4')}) AS t FROM orders)")
def form_check(spark, d):
    """Share of the indicators in the head's text."""
    head = F.lower(X.pick(_HEADS, F.col("o_orderkey") % 4))
    score = sum(head.contains(w).cast("int") for w in INDICATORS) / F.lit(float(len(INDICATORS)))
    return X.load(spark, d, "orders").select("o_orderkey", score.alias("score"), (score > 0.3).alias("is_form"))


def named_claim(name: Column) -> Column:
    """Whether a file name tells the claim form."""
    low = F.lower(name)
    return low.contains("cms1500") | low.contains("cms-1500")


_NAMED = "(contains(lower(name), 'cms1500') OR contains(lower(name), 'cms-1500'))"


@query("form_check_filename", f"SELECT o_orderkey, CASE WHEN {_NAMED} THEN 'cms1500' ELSE 'generic' END AS form, CASE WHEN {_NAMED} THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM (SELECT o_orderkey, {X.pick_sql(_NAMES, 'o_custkey % 4')} || o_orderkey || '.PDF' AS name FROM orders)")
def form_check_filename(spark, d):
    claim = named_claim(F.concat(X.pick(_NAMES, F.col("o_custkey") % 4), "o_orderkey", F.lit(".PDF")))
    return X.load(spark, d, "orders").select("o_orderkey", F.when(claim, "cms1500").otherwise("generic").alias("form"), F.when(claim, 0.9).otherwise(0.5).alias("confidence"))


_FOUND = ("cms1500", "ub04", "ncpdp")


@query("form_final", f"SELECT o_orderkey, CASE WHEN c < 0.2::DOUBLE THEN CASE WHEN {_NAMED} THEN 'cms1500' ELSE 'generic' END ELSE form END AS form, CASE WHEN c < 0.2::DOUBLE THEN CASE WHEN {_NAMED} THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END ELSE c END AS confidence, c < 0.2::DOUBLE OR c > 0.3::DOUBLE AS matched FROM (SELECT o_orderkey, o_orderkey % 11 / 10.0::DOUBLE AS c, {X.pick_sql(_FOUND, 'o_orderkey % 3')} AS form, {X.pick_sql(_NAMES, 'o_custkey % 4')} || o_orderkey AS name FROM orders)")
def form_final(spark, d):
    """Below 0.2 a form is generic at 0.5, which counts as matched as anything above 0.3 does; then a file name may still tell the claim form, at 0.8."""
    c, low = F.col("c"), F.col("c") < 0.2
    claim = low & named_claim(F.col("name"))
    o = X.load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 11 / F.lit(10.0)).alias("c"), X.pick(_FOUND, F.col("o_orderkey") % 3).alias("found"), F.concat(X.pick(_NAMES, F.col("o_custkey") % 4), "o_orderkey").alias("name"))
    form = F.when(claim, "cms1500").when(low, "generic").otherwise(F.col("found"))
    return o.select("o_orderkey", form.alias("form"), F.when(claim, 0.8).when(low, 0.5).otherwise(c).alias("confidence"), (low | (c > 0.3)).alias("matched"))


# -- pages ------------------------------------------------------------------------


@query("orientation", X.with_("SELECT doc_id, CASE WHEN v > h * 1.25::DOUBLE THEN 90.0 ELSE 0.0 END::DOUBLE AS degrees, CASE WHEN h + v > 0 THEN abs(v - h) / (h + v) ELSE 0.0::DOUBLE END AS confidence FROM (SELECT doc_id, sum(CASE WHEN type = 'table' THEN x1 - x0 ELSE 0 END) AS h, sum(CASE WHEN type IN ('figure', 'form') THEN (y1 - y0) * 4 ELSE 0 END) AS v FROM blocks GROUP BY doc_id)", X.BLOCKS))
def orientation(spark, d):
    """90 degrees where vertical lines have over 1.25 times the energy of horizontal ones; a page without lines is upright, at 0. The energy, which a plug-in measures, is here the width of tables and four times the height of figures and forms."""
    h = F.sum(F.when(F.col("type") == "table", F.col("x1") - F.col("x0")).otherwise(0.0)).alias("h")
    v = F.sum(F.when(F.col("type").isin("figure", "form"), (F.col("y1") - F.col("y0")) * 4).otherwise(0.0)).alias("v")
    pages, both = X.blocks(spark, d).groupBy("doc_id").agg(h, v), F.col("h") + F.col("v")
    return pages.select("doc_id", F.when(F.col("v") > F.col("h") * 1.25, 90.0).otherwise(0.0).alias("degrees"), F.when(both > 0, F.abs(F.col("v") - F.col("h")) / both).otherwise(0.0).alias("confidence"))


#: Column centres of the known templates as parts of the page's width (fixed values).
TEMPLATES = {"cms-1500": (0.17, 0.40, 0.63, 0.85), "ncpdp": (0.22, 0.52, 0.78), "ub-04": (0.18, 0.46, 0.74)}
_HINTS = ("CMS-1500", "ncpdp", "UB-04", "other")
_COLUMNS = ", ".join(f"('{t}', {i}, {c}::DOUBLE)" for t, cs in TEMPLATES.items() for i, c in enumerate(cs))


@query("template_centers", f"SELECT o_orderkey, nth, least(w, greatest(0.0::DOUBLE, part * w)) AS center FROM (SELECT o_orderkey, lower({X.pick_sql(_HINTS, 'o_orderkey % 4')}) AS hint, (1700 + o_custkey % 3 * 425)::DOUBLE AS w FROM orders) JOIN (VALUES {_COLUMNS}) t(template, nth, part) ON hint = template")
def template_centers(spark, d):
    """Column centres in pixels of pages with a known template; others have none."""
    known = F.create_map(*[x for t, cs in TEMPLATES.items() for x in (F.lit(t), F.array(*map(F.lit, cs)))])
    hint, w = F.lower(X.pick(_HINTS, F.col("o_orderkey") % 4)), (1700 + F.col("o_custkey") % 3 * 425).cast("double").alias("w")
    pages = X.load(spark, d, "orders").select("o_orderkey", w, F.posexplode(F.try_element_at(known, hint)).alias("nth", "part"))
    return pages.select("o_orderkey", "nth", F.least("w", F.greatest(F.lit(0.0), F.col("part") * F.col("w"))).alias("center"))


_NEAR = "sqrt(((b.x0 + b.x1) / 16 - (f.x0 + f.x1) / 16) * ((b.x0 + b.x1) / 16 - (f.x0 + f.x1) / 16) + ((b.y0 + b.y1) / 16 - (f.y0 + f.y1) / 16) * ((b.y0 + b.y1) / 16 - (f.y0 + f.y1) / 16)) < 40"


@query("caption_semi", X.with_(f"SELECT doc_id, seq FROM blocks b WHERE type = 'text' AND EXISTS (SELECT 1 FROM blocks f WHERE f.type = 'figure' AND f.doc_id = b.doc_id AND {_NEAR})", X.BLOCKS))
def caption_semi(spark, d):
    """Text blocks whose centre lies within 40 pixels of a figure's on the same page; pages at an eighth of their size."""
    b = X.blocks(spark, d)
    figures = b.where("type = 'figure'").select("doc_id", "x0", "y0", "x1", "y1").alias("f")
    return b.where("type = 'text'").alias("b").join(figures, F.expr(f"b.doc_id = f.doc_id AND {_NEAR}"), "left_semi").select("doc_id", "seq")


#: Rows of pixels that a segment must exceed.
_GAP = 18


@query("blank_row_segments", X.with_(f"SELECT doc_id, seq, least(x0, 2549) AS left_, y0 + a AS y_top, least(x1, 2550) AS right_, y0 + b AS y_bottom FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, seq) AS n FROM (SELECT doc_id, seq, x0, y0, x1, k, min(i) AS a, max(i) + 1 AS b FROM (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id, seq ORDER BY i) AS k FROM (SELECT *, (i + doc_id) % (25 + seq * 3) < 5 AS blank FROM (SELECT *, unnest(range(0, (y1 - y0)::BIGINT)) AS i FROM blocks WHERE type = 'table'))) WHERE NOT blank GROUP BY ALL) WHERE b - a > {_GAP}) WHERE n > 1", X.BLOCKS))
def blank_row_segments(spark, d):
    """Parts of a table between blank rows, each of more than 18 rows; a table with one such part is not split.

    A plug-in tells the blank rows; here five in each 25 and more are blank. The parts are read off an array, without a shuffle.
    """
    high = (F.col("y1") - F.col("y0")).cast("long")
    ends = F.filter(F.sequence(F.lit(0).cast("long"), high), lambda i: (i == high) | ((i + F.col("doc_id")) % (25 + F.col("seq") * 3) < 5))
    t = X.blocks(spark, d).where("type = 'table'").withColumn("ends", ends)
    begins = F.transform(F.concat(F.array(F.lit(-1).cast("long")), F.slice("ends", 1, F.size("ends") - 1)), lambda i: i + 1)
    t = t.withColumn("parts", F.filter(F.arrays_zip(begins.alias("a"), F.col("ends").alias("b")), lambda p: p["b"] - p["a"] > _GAP)).where("size(parts) > 1")
    x0, _, x1, _ = G.clip(G.box(), X.PAGE_W, X.PAGE_H)
    return t.select("doc_id", "seq", x0.alias("left_"), x1.alias("right_"), "y0", F.explode("parts").alias("p")).select("doc_id", "seq", "left_", "right_", (F.col("y0") + F.col("p.a")).alias("y_top"), (F.col("y0") + F.col("p.b")).alias("y_bottom"))


# -- filters of blocks ------------------------------------------------------------


@query("table_model_boxes", X.with_("SELECT doc_id, seq, (x1 - x0) * (y1 - y0) / 160000.0::DOUBLE AS share FROM blocks WHERE type = 'table' AND (x1 - x0) * (y1 - y0) / 160000.0::DOUBLE <= 0.55::DOUBLE AND x1 - x0 >= 80 AND y1 - y0 >= 80", X.BLOCKS))
def table_model_boxes(spark, d):
    """Boxes of a table model: at most 0.55 of the page, here of 400 by 400 pixels, and no side below 80."""
    share = G.area(G.box()) / F.lit(160000.0)
    return X.blocks(spark, d).where("type = 'table'").where((share <= 0.55) & F.expr("x1 - x0 >= 80 AND y1 - y0 >= 80")).select("doc_id", "seq", share.alias("share"))


@query("block_gates", X.with_("SELECT doc_id, seq, type IN ('text', 'title', 'list', 'form') AS read, seq % 4 <> 0 AND type IN ('text', 'title', 'list') AND length(trim(t)) > 0 AS labelled FROM (SELECT *, CASE WHEN seq % 5 = 1 THEN '  ' ELSE text END AS t FROM blocks)", X.BLOCKS))
def block_gates(spark, d):
    """Which blocks recognition reads, and which the labeller sees: those of text whose role is not locked (here each fourth is) and that have text."""
    t = F.when(F.col("seq") % 5 == 1, "  ").otherwise(F.col("text"))
    labelled = (F.col("seq") % 4 != 0) & F.col("type").isin("text", "title", "list") & (F.length(F.trim(t)) > 0)
    return X.blocks(spark, d).select("doc_id", "seq", F.col("type").isin("text", "title", "list", "form").alias("read"), labelled.alias("labelled"))


# -- grounding --------------------------------------------------------------------


@F.pandas_udf(IntegerType())
def most_alike(target: pd.Series, texts: pd.Series) -> pd.Series:
    """Place of the text most alike to the target by matching blocks, if above 0.7; the first one on a tie."""

    def place(t, of):
        best, at = 0.7, None
        for i, text in enumerate(of if of is not None and t else ()):
            if text and (ratio := SequenceMatcher(None, t, text.lower().strip()).ratio()) > best:
                best, at = ratio, i
        return at

    return pd.Series([place(t, of) for t, of in zip(target, texts)], dtype="Int32")


@query("fuzzy_find_bbox")
def fuzzy_find_bbox(spark, d):
    """Box of a value on its page: the first block, in order, that is or holds the value, else the one most alike. No SQL form of the ratio; a test compares by brute force.

    The values are a block's text, the head of one, and one with a slip. Only pages without a holding block reach Python.
    """
    b = X.blocks(spark, d)
    value = F.when(F.col("doc_id") % 3 == 0, F.upper("text")).when(F.col("doc_id") % 3 == 1, F.split("text", " from")[0]).otherwise(F.replace("text", F.lit("from"), F.lit("form")))
    wanted = b.where("seq = doc_id % 2").select("doc_id", F.trim(F.lower(value)).alias("value"))
    clean, place = F.trim(F.lower("text")), F.struct("seq", "x0", "y0", "x1", "y1")
    pages = b.join(wanted, "doc_id").groupBy("doc_id", "value").agg(
        F.min(F.when(clean.contains(F.col("value")), place)).alias("held"),
        F.array_sort(F.collect_list(F.struct("seq", "x0", "y0", "x1", "y1", "text"))).alias("all"),
    )
    near = most_alike("value", F.when(F.col("held").isNull(), F.col("all.text")))
    pages = pages.withColumn("near", near)
    at = lambda c: F.coalesce(F.col(f"held.{c}"), F.when(F.col("near").isNotNull(), F.get("all", "near")[c])).alias(c)
    return pages.select("doc_id", "value", F.when(F.col("held").isNotNull(), "held").when(F.col("near").isNotNull(), "alike").alias("how"), *map(at, ("seq", "x0", "y0", "x1", "y1")))
