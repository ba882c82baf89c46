"""Queries of the box functions and of spatial pairs within a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwork.functions import geometry as G
from leafwork.plans.registry import query
from leafwork.sources import fixtures as X

W, H = X.PAGE_W, X.PAGE_H
B = lambda: G.box()  # noqa: E731  columns need a session, so they are made when a query runs


def _boxes(name: str, new, sql: str) -> None:
    query(name, X.with_(f"SELECT doc_id, seq, {sql} FROM blocks", X.BLOCKS))(lambda spark, d: X.blocks(spark, d).select("doc_id", "seq", *new()))


_boxes("clip_bbox", lambda: G.named(G.clip(B(), 1500, 2000), "c_"), "greatest(0.0, least(x0, 1499.0)) AS c_x0, greatest(0.0, least(y0, 1999.0)) AS c_y0, greatest(greatest(0.0, least(x0, 1499.0)) + 1, least(x1, 1500.0)) AS c_x1, greatest(greatest(0.0, least(y0, 1999.0)) + 1, least(y1, 2000.0)) AS c_y1")
_boxes("clamp_bbox", lambda: G.named(G.clamp((F.col("x1"), F.col("y0"), F.col("x0"), F.col("y1")), 1500, 2000), "c_"), "least(greatest(0.0, least(x0, 1500.0)), greatest(0.0, least(x1, 1500.0))) AS c_x0, least(greatest(0.0, least(y0, 2000.0)), greatest(0.0, least(y1, 2000.0))) AS c_y0, greatest(greatest(0.0, least(x0, 1500.0)), greatest(0.0, least(x1, 1500.0))) AS c_x1, greatest(greatest(0.0, least(y0, 2000.0)), greatest(0.0, least(y1, 2000.0))) AS c_y1")
_boxes("shrink_bbox", lambda: G.named(G.shrink(B(), 0.04), "s_"), "x0 + greatest(1.0, x1 - x0) * 0.04::DOUBLE AS s_x0, y0 + greatest(1.0, y1 - y0) * 0.04::DOUBLE AS s_y0, x1 - greatest(1.0, x1 - x0) * 0.04::DOUBLE AS s_x1, y1 - greatest(1.0, y1 - y0) * 0.04::DOUBLE AS s_y1")
_boxes("expand_bbox", lambda: G.named(G.expand(B(), 12, W, H), "e_"), f"greatest(0.0, x0 - 12) AS e_x0, greatest(0.0, y0 - 12) AS e_y0, least({W}.0, x1 + 12) AS e_x1, least({H}.0, y1 + 12) AS e_y1")
_boxes("abs_to_norm", lambda: [(F.col("x0") / W).alias("left_"), (F.col("y0") / H).alias("top_"), ((F.col("x1") - F.col("x0")) / W).alias("width_"), ((F.col("y1") - F.col("y0")) / H).alias("height_")], f"x0 / {W} AS left_, y0 / {H} AS top_, (x1 - x0) / {W} AS width_, (y1 - y0) / {H} AS height_")
_boxes("bbox_to_yolo", lambda: [((F.col("x0") + F.col("x1")) / 2 / W).alias("cx"), ((F.col("y0") + F.col("y1")) / 2 / H).alias("cy"), ((F.col("x1") - F.col("x0")) / W).alias("bw"), ((F.col("y1") - F.col("y0")) / H).alias("bh")], f"(x0 + x1) / 2 / {W} AS cx, (y0 + y1) / 2 / {H} AS cy, (x1 - x0) / {W} AS bw, (y1 - y0) / {H} AS bh")
_boxes("crop_box", lambda: [F.when((G.area(B()) > 0) & (G.area(B()) / (W * H) <= 0.55), F.greatest(F.lit(0.0), F.col("x0") - 8)).alias("crop_x0"), F.when((G.area(B()) > 0) & (G.area(B()) / (W * H) <= 0.55), F.least(F.lit(float(H)), F.col("y1") + 8)).alias("crop_y1")], f"CASE WHEN (x1 - x0) * (y1 - y0) > 0 AND (x1 - x0) * (y1 - y0) / {W * H} <= 0.55 THEN greatest(0.0, x0 - 8) END AS crop_x0, CASE WHEN (x1 - x0) * (y1 - y0) > 0 AND (x1 - x0) * (y1 - y0) / {W * H} <= 0.55 THEN least({H}.0, y1 + 8) END AS crop_y1")
_boxes("zone_expand", lambda: [F.greatest(F.lit(0), F.col("x0").cast("int") - F.greatest(((F.col("x1") - F.col("x0")) * 0.15).cast("int"), F.lit(8))).alias("ex0"), F.least(F.lit(W), F.col("x1").cast("int") + F.greatest(((F.col("x1") - F.col("x0")) * 0.15).cast("int"), F.lit(8))).alias("ex1")], f"greatest(0, trunc(x0)::INT - greatest(trunc((x1 - x0) * 0.15::DOUBLE)::INT, 8)) AS ex0, least({W}, trunc(x1)::INT + greatest(trunc((x1 - x0) * 0.15::DOUBLE)::INT, 8)) AS ex1")
_boxes("block_features", lambda: [G.area(B()).alias("area"), ((F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("aspect"), (F.col("x1") - F.col("x0")).alias("width_"), (F.col("y1") - F.col("y0")).alias("height_")], "(x1 - x0) * (y1 - y0) AS area, (x1 - x0) / (y1 - y0) AS aspect, x1 - x0 AS width_, y1 - y0 AS height_")
_boxes("bbox_format", lambda: [F.when((F.col("x0") <= 1) & (F.col("y0") <= 1) & (F.col("x1") <= 1) & (F.col("y1") <= 1), "normalised").when((F.col("x1") < F.col("x0")) | (F.col("y1") < F.col("y0")), "ltwh").otherwise("absolute").alias("format_")], "CASE WHEN x0 <= 1 AND y0 <= 1 AND x1 <= 1 AND y1 <= 1 THEN 'normalised' WHEN x1 < x0 OR y1 < y0 THEN 'ltwh' ELSE 'absolute' END AS format_")
_boxes("yolo_labels", lambda: [F.format_string("%d %.6f %.6f", (F.col("seq") % 7).cast("int"), F.col("x0") / W, F.col("y0") / H).alias("label")], f"printf('%d %.6f %.6f', (seq % 7)::INT, x0 / {W}, y0 / {H}) AS label")
_M = [1.0, 0.25, 8.0, 0.125, 1.0, 4.0, 0.0, 0.0, 1.0]
_PX, _PY = ("x0 + y0 * 0.25 + 8", "x1 + y0 * 0.25 + 8", "x1 + y1 * 0.25 + 8", "x0 + y1 * 0.25 + 8"), ("x0 * 0.125 + y0 + 4", "x1 * 0.125 + y0 + 4", "x1 * 0.125 + y1 + 4", "x0 * 0.125 + y1 + 4")
_boxes("homography_bbox", lambda: G.named(G.project(B(), _M), "h_"), f"least({', '.join(_PX)})::DOUBLE AS h_x0, least({', '.join(_PY)})::DOUBLE AS h_y0, greatest({', '.join(_PX)})::DOUBLE AS h_x1, greatest({', '.join(_PY)})::DOUBLE AS h_y1")


@query("norm_to_abs", X.with_(f"SELECT zone, zx0 / {W} * 1700 AS ax0, zy0 / {H} * 2200 AS ay0 FROM zones", X.ZONES))
def norm_to_abs(spark, d):
    return X.zones(spark).select("zone", (F.col("zx0") / W * 1700).alias("ax0"), (F.col("zy0") / H * 2200).alias("ay0"))


@query("schema_zones", X.with_("SELECT * FROM zones", X.ZONES))
def schema_zones(spark, d):
    return X.zones(spark)


@query("zone_block_type", X.with_("SELECT zone, CASE WHEN ztype = 'checkbox' THEN 'checkbox' WHEN ztype = 'signature' THEN 'signature' WHEN contains(zone, 'table') THEN 'table' ELSE 'form_field' END AS block_type, 0.9::DOUBLE AS confidence FROM zones", X.ZONES))
def zone_block_type(spark, d):
    kind = F.when(F.col("ztype").isin("checkbox", "signature"), F.col("ztype")).when(F.col("zone").contains("table"), "table").otherwise("form_field")
    return X.zones(spark).select("zone", kind.alias("block_type"), F.lit(0.9).alias("confidence"))


# -- pairs of blocks on a page: always joined on the page first -----------------

A_, B_ = (lambda: G.box("a.")), (lambda: G.box("b."))
_W, _H = "least(a.x1, b.x1) - greatest(a.x0, b.x0)", "least(a.y1, b.y1) - greatest(a.y0, b.y0)"
OVERLAP = f"(CASE WHEN {_W} > 0 AND {_H} > 0 THEN ({_W}) * ({_H}) ELSE 0.0 END)"
AREA_A, AREA_B = "((a.x1 - a.x0) * (a.y1 - a.y0))", "((b.x1 - b.x0) * (b.y1 - b.y0))"
IOU = f"(CASE WHEN {OVERLAP} > 0 THEN {OVERLAP} / ({AREA_A} + {AREA_B} - {OVERLAP}) ELSE 0.0 END)"
INSIDE = f"({OVERLAP} / {AREA_A})"


def pairs(spark, d):
    b = X.blocks(spark, d)
    return b.alias("a").join(b.alias("b"), F.col("a.doc_id") == F.col("b.doc_id"))


@query("iou_pairs", X.with_(f"SELECT a.doc_id, a.seq AS seq_a, b.seq AS seq_b, {IOU} AS iou FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.seq < b.seq WHERE {IOU} > 0", X.BLOCKS))
def iou_pairs(spark, d):
    return pairs(spark, d).where("a.seq < b.seq").select("a.doc_id", F.col("a.seq").alias("seq_a"), F.col("b.seq").alias("seq_b"), G.iou(A_(), B_()).alias("iou")).where("iou > 0")


@query("containment", X.with_(f"SELECT a.doc_id, a.seq AS inner_seq, b.seq AS outer_seq, {INSIDE} AS share FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.seq <> b.seq WHERE {INSIDE} > 0.9", X.BLOCKS))
def containment(spark, d):
    return pairs(spark, d).where("a.seq <> b.seq").select("a.doc_id", F.col("a.seq").alias("inner_seq"), F.col("b.seq").alias("outer_seq"), G.share_inside(A_(), B_()).alias("share")).where("share > 0.9")


def _anti(name: str, left: str, right: str, sql_on: str, on) -> None:
    """Blocks on the left without a partner on the right of the same page."""
    sql = f"SELECT a.doc_id, a.seq FROM blocks a WHERE {left} AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = a.doc_id AND {right} AND b.seq <> a.seq AND {sql_on})"

    def run(spark, d):
        b = X.blocks(spark, d)
        q = lambda s: s.replace("a.", "").replace("b.", "")
        lhs, rhs = b.where(q(left)).alias("a"), b.where(q(right)).alias("b")
        return lhs.join(rhs, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.seq") != F.col("b.seq")) & on(), "left_anti").select("doc_id", "seq")

    query(name, X.with_(sql, X.BLOCKS))(run)


_anti("filter_new_blocks", "a.type = 'table'", "b.type <> 'table'", f"{IOU} >= 0.4", lambda: G.iou(A_(), B_()) >= 0.4)
_anti("suppress_in_form", "a.type <> 'table'", "b.type = 'form'", f"({IOU} > 0.7 AND {AREA_A} / {W * H} < 0.05)", lambda: (G.iou(A_(), B_()) > 0.7) & (G.area(A_()) / (W * H) < 0.05))
_anti("drop_redundant_text", "a.type IN ('text', 'title')", "b.type IN ('form', 'table')", f"{INSIDE} > 0.8", lambda: G.share_inside(A_(), B_()) > 0.8)


_BESIDE = """(a.x0, a.y0, a.x1, a.y1) <> (b.x0, b.y0, b.x1, b.y1) AND sqrt(power((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2, 2) + power((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2, 2)) <= {times} * greatest(a.x1 - a.x0, a.y1 - a.y0)"""


@query("checkbox_neighbour", X.with_("SELECT a.doc_id, a.seq FROM blocks a WHERE a.type = 'form' AND EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = a.doc_id AND b.type = 'form' AND " + _BESIDE.format(times=1.65) + ")", X.BLOCKS))
def checkbox_neighbour(spark, d, strictness: float = 0.7):
    """Checkboxes with another one of another box whose middle is within 2 - strictness / 2 times the longer side."""
    f = X.blocks(spark, d).where("type = 'form'")
    beside = _BESIDE.format(times=2.0 - 0.5 * strictness).replace("(a.x0, a.y0, a.x1, a.y1) <> (b.x0, b.y0, b.x1, b.y1)", "struct(a.x0, a.y0, a.x1, a.y1) <> struct(b.x0, b.y0, b.x1, b.y1)")
    return f.alias("a").join(f.alias("b"), F.expr("a.doc_id = b.doc_id AND " + beside), "left_semi").select("doc_id", "seq")


@query("detector_filter", X.with_("SELECT doc_id, seq, type FROM blocks WHERE confidence >= CASE WHEN type IN ('text', 'title', 'list', 'form', 'figure') THEN greatest(0.15, 0.8 * 0.7)::DOUBLE WHEN type = 'table' THEN greatest(0.2, 0.8 * 0.85)::DOUBLE ELSE 0.8 END", X.BLOCKS))
def detector_filter(spark, d, threshold: float = 0.8):
    least = F.when(F.col("type").isin("text", "title", "list", "form", "figure"), max(0.15, round(threshold * 0.7, 9))).when(F.col("type") == "table", max(0.2, round(threshold * 0.85, 9))).otherwise(threshold)
    return X.blocks(spark, d).where(F.col("confidence") >= least).select("doc_id", "seq", "type")


_BIG = f"(x1 - x0) * (y1 - y0) / {W * H} > 0.85"


@query("drop_giant", X.with_(f"SELECT doc_id, seq FROM (SELECT *, count(*) FILTER (NOT ({_BIG})) OVER (PARTITION BY doc_id) AS rest FROM blocks) WHERE rest < 3 OR NOT ({_BIG})", X.BLOCKS))
def drop_giant(spark, d, most: float = 0.85):
    """Blocks that cover too much of the page go, unless fewer than three would be left."""
    from pyspark.sql import Window

    big = G.area(B()) / (W * H) > most
    rest = F.count_if(~big).over(Window.partitionBy("doc_id"))
    return X.blocks(spark, d).withColumn("rest", rest).where((F.col("rest") < 3) | ~big).select("doc_id", "seq")
