"""Queries of form identification, field links, tables, engine choice, templates and record assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafwork.functions import geometry as G
from leafwork.functions import text as T
from leafwork.functions import validate as V
from leafwork.operators import texture
from leafwork.operators import zones as Z
from leafwork.plans.joins import MATCHED
from leafwork.plans.registry import query
from leafwork.sources import fixtures as X


def pick_label_column():
    return X.pick(_LABELS, F.col("seq") % 6)


# -- words in zones by other tests than the unique one ----------------------------


@query("digital_words_in_zone", X.with_("SELECT doc_id, pos, zone FROM words JOIN zones ON x0 >= zx0 - 2 AND y0 >= zy0 - 2 AND x1 <= zx1 + 2 AND y1 <= zy1 + 2", X.WORDS, X.ZONES))
def digital_words_in_zone(spark, d):
    """Words that lie in a zone altogether, within two pixels."""
    z = Z.match_overlap(X.words(spark, d), X.zones(spark), 2.0).join(F.broadcast(X.zones(spark)), ["zone", "ord"])
    return z.where("x0 >= zx0 - 2 and y0 >= zy0 - 2 and x1 <= zx1 + 2 and y1 <= zy1 + 2").select("doc_id", "pos", "zone")


@query("boxes_in_zone", X.with_("SELECT zone, doc_id, count(*) AS n FROM words JOIN zones ON least(x1, zx1 + 10) > greatest(x0, zx0 - 10) AND least(y1, zy1 + 10) > greatest(y0, zy0 - 10) GROUP BY ALL", X.WORDS, X.ZONES))
def boxes_in_zone(spark, d):
    return Z.match_overlap(X.words(spark, d), X.zones(spark), 10.0).groupBy("zone", "doc_id").agg(F.count("*").alias("n"))


@query("zone_propose", X.with_("SELECT zone, greatest(0.0, least(1700.0, zx0 / 2550 * 1700)) - 10 AS px0, greatest(0.0, least(2200.0, zy0 / 3300 * 2200)) - 12 AS py0, greatest(0.0, least(1700.0, zx1 / 2550 * 1700)) + 10 AS px1, greatest(0.0, least(2200.0, zy1 / 3300 * 2200)) + 12 AS py1 FROM zones", X.ZONES))
def zone_propose(spark, d):
    """Zones on a page of another size: projected, clamped, then padded without clamping again."""
    b = G.clamp((F.col("zx0") / 2550 * 1700, F.col("zy0") / 3300 * 2200, F.col("zx1") / 2550 * 1700, F.col("zy1") / 3300 * 2200), 1700, 2200)
    return X.zones(spark).select("zone", (b[0] - 10).alias("px0"), (b[1] - 12).alias("py0"), (b[2] + 10).alias("px1"), (b[3] + 12).alias("py1"))


# -- forms ------------------------------------------------------------------------

#: Words that tell a form (fixed values): strong ones decide, the others count.
STRONG = {"ub04": ("ub-04", "ub04", "uniform bill", "ub 04"), "cms1500": ("cms-1500", "cms 1500", "cms1500", "hcfa-1500"), "ncpdp": ("ncpdp",)}
COUNTED = {
    "cms1500": ("cms-1500", "cms 1500", "health insurance claim form", "approved by national uniform claim committee", "hcfa-1500", "please print or type"),
    "ub04": ("ub-04", "ub04", "uniform bill", "patient control no", "med rec no"),
    "ncpdp": ("ncpdp", "universal claim form", "pharmacy claim"),
}
_HEADS = ("HEALTH INSURANCE CLAIM FORM please print or type approved by", "Uniform Bill med rec no", "CMS-1500 02/12", "pharmacy claim, universal claim form", "letter", "patient control no med rec no", "health insurance claim form")


def _count_sql(form: str) -> str:
    return "(" + " + ".join(f"contains(t, '{w}')::INT" for w in COUNTED[form]) + f") / {len(COUNTED[form])}.0::DOUBLE + 0.15::DOUBLE"


def _strong_sql(form: str) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in STRONG[form]) + ")"


_FORM_SQL = "CASE " + " ".join(f"WHEN {_strong_sql(f)} THEN '{f}'" for f in STRONG) + " " + " ".join(f"WHEN {_count_sql(f)} >= 0.45 AND " + " AND ".join(f"{_count_sql(f)} >= {_count_sql(g)}" for g in COUNTED if g != f) + f" THEN '{f}'" for f in COUNTED) + " ELSE 'generic' END"


@query("form_identify", f"SELECT o_orderkey, {_FORM_SQL} AS form, CASE WHEN contains(t, '02/12') THEN '2012 revision' END AS version FROM (SELECT o_orderkey, lower({X.pick_sql(_HEADS, 'o_orderkey % 7')}) AS t FROM orders)")
def form_identify(spark, d):
    t = F.col("t")
    has = lambda ws: reduce(lambda a, b: a | b, [t.contains(w) for w in ws])
    score = {f: sum(t.contains(w).cast("int") for w in ws) / F.lit(float(len(ws))) + F.lit(0.15) for f, ws in COUNTED.items()}
    most = F.greatest(*score.values())
    out = F.coalesce(*[F.when(has(ws), F.lit(f)) for f, ws in STRONG.items()], *[F.when((score[f] >= 0.45) & (score[f] == most), F.lit(f)) for f in COUNTED], F.lit("generic"))
    o = X.load(spark, d, "orders").select("o_orderkey", F.lower(X.pick(_HEADS, F.col("o_orderkey") % 7)).alias("t"))
    return o.select("o_orderkey", out.alias("form"), F.when(t.contains("02/12"), "2012 revision").alias("version"))


_ANCHOR = r"(regexp_matches(f_member_id, '^[A-Za-z]{2}[0-9]+')::INT + regexp_matches(f_date, '[0-9]+/[0-9]+/[0-9]+')::INT + regexp_matches(f_state, '^[A-Z]{2}$')::INT)"


@query("anchor_score", X.with_(f"SELECT o_orderkey, {_ANCHOR} AS score, {_ANCHOR} >= 2 AS trusted FROM fields", X.FIELDS))
def anchor_score(spark, d):
    """A text layer is trusted if two of three anchors look right."""
    s = sum(F.col(c).rlike(p).cast("int") for c, p in (("f_member_id", "^[A-Za-z]{2}[0-9]+"), ("f_date", "[0-9]+/[0-9]+/[0-9]+"), ("f_state", "^[A-Z]{2}$")))
    return X.fields(spark, d).select("o_orderkey", s.alias("score"), (s >= 2).alias("trusted"))


#: Detector classes to block types (fixed values).
CLASSES = {"Caption": "text", "Footnote": "text", "Formula": "text", "List-item": "list", "Page-footer": "text", "Page-header": "text", "Picture": "figure", "Section-header": "title", "Table": "table", "Text": "text", "Title": "title"}


@query("map_block_type", X.with_("SELECT doc_id, seq, class, upper(class) AS label, CASE class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASSES.items()) + f" ELSE 'unknown' END AS mapped FROM (SELECT doc_id, seq, {X.pick_sql((*CLASSES, 'Other'), 'seq % 12')} AS class FROM blocks)", X.BLOCKS))
def map_block_type(spark, d):
    known = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    b = X.blocks(spark, d).select("doc_id", "seq", X.pick((*CLASSES, "Other"), F.col("seq") % 12).alias("class"))
    return b.select("doc_id", "seq", "class", F.upper("class").alias("label"), F.coalesce(known[F.col("class")], F.lit("unknown")).alias("mapped"))


@query("export_block_type", X.with_("SELECT doc_id, seq, CASE type WHEN 'table' THEN 'Table' WHEN 'figure' THEN 'Figure' WHEN 'title' THEN 'Title' ELSE CASE WHEN contains(text, ':') OR contains(text, '=') THEN 'Key Value' ELSE 'Text' END END AS kind, CASE WHEN confidence > 0.85 THEN 'high' WHEN confidence > 0.6 THEN 'medium' ELSE 'low' END AS band FROM blocks", X.BLOCKS))
def export_block_type(spark, d):
    t, c = F.col("type"), F.col("confidence")
    kind = F.when(t.isin("table", "figure", "title"), F.initcap(t)).when(F.col("text").contains(":") | F.col("text").contains("="), "Key Value").otherwise("Text")
    return X.blocks(spark, d).select("doc_id", "seq", kind.alias("kind"), F.when(c > 0.85, "high").when(c > 0.6, "medium").otherwise("low").alias("band"))


@query("training_class", X.with_("SELECT zone, CASE WHEN ztype = 'checkbox' THEN 1 WHEN ztype = 'signature' THEN 2 WHEN ztype = 'date' THEN 3 ELSE 0 END AS class_id FROM zones", X.ZONES))
def training_class(spark, d):
    t = F.col("ztype")
    return X.zones(spark).select("zone", F.when(t == "checkbox", 1).when(t == "signature", 2).when(t == "date", 3).otherwise(0).alias("class_id"))


# -- engines and tiers --------------------------------------------------------------

_RATIO = r"length(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g'))::DOUBLE / greatest(length({0}), 1)"
_A, _B = _RATIO.format("s"), _RATIO.format("other")


@query("pick_engine", X.with_(f"SELECT o_orderkey, CASE WHEN (length(s) <= 2 OR {_A} < 0.55) AND NOT (length(other) <= 2 OR {_B} < 0.55) THEN 'second' WHEN {_B} > {_A} + 0.1::DOUBLE THEN 'second' WHEN length(other) > length(s) + 3 AND NOT (length(other) <= 2 OR {_B} < 0.55) THEN 'second' ELSE 'first' END AS engine FROM (SELECT o_orderkey, s, CASE WHEN o_orderkey % 3 = 0 THEN 'clean reading' ELSE '| . ,' END AS other FROM strings)", X.STRINGS))
def pick_engine(spark, d):
    ratio = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")).cast("double") / F.greatest(F.length(c), F.lit(1))
    noisy = lambda c: (F.length(c) <= 2) | (ratio(c) < 0.55)
    s = X.strings(spark, d).withColumn("other", F.when(F.col("o_orderkey") % 3 == 0, "clean reading").otherwise("| . ,"))
    second = (noisy("s") & ~noisy("other")) | (ratio("other") > ratio("s") + 0.1) | ((F.length("other") > F.length("s") + 3) & ~noisy("other"))
    return s.select("o_orderkey", F.when(second, "second").otherwise("first").alias("engine"))


@query("ocr_tiering", X.with_("SELECT doc_id, seq, CASE WHEN confidence >= 0.75 THEN 'engine' WHEN c2 >= 0.72 THEN 'again' WHEN c2 >= 0.6 THEN 'second engine' ELSE 'model' END AS tier FROM (SELECT *, (50 + (seq * 7 + doc_id) % 50) / 100.0::DOUBLE AS c2 FROM blocks)", X.BLOCKS))
def ocr_tiering(spark, d):
    """Which tier's reading of a block is used: each is asked only where the ones before were unsure."""
    c2 = (50 + (F.col("seq") * 7 + F.col("doc_id")) % 50) / F.lit(100.0)
    return X.blocks(spark, d).select("doc_id", "seq", F.when(F.col("confidence") >= 0.75, "engine").when(c2 >= 0.72, "again").when(c2 >= 0.6, "second engine").otherwise("model").alias("tier"))


@query("tess_normalise", X.with_("SELECT doc_id, pos, raw / 100.0::DOUBLE AS confidence FROM (SELECT *, CAST(round(confidence * 100) AS INT) - 45 AS raw FROM words) WHERE raw >= 0 AND trim(token) <> ''", X.WORDS))
def tess_normalise(spark, d):
    w = X.words(spark, d).withColumn("raw", F.round(F.col("confidence") * 100).cast("int") - 45)
    return w.where((F.col("raw") >= 0) & (F.trim("token") != "")).select("doc_id", "pos", (F.col("raw") / F.lit(100.0)).alias("confidence"))


@query("quad_to_box", X.with_("SELECT doc_id, seq, least(x0, x1, x1 + 3, x0 - 2) AS bx0, least(y0, y0 + 1, y1, y1 - 4) AS by0, greatest(x0, x1, x1 + 3, x0 - 2) AS bx1, greatest(y0, y0 + 1, y1, y1 - 4) AS by1 FROM blocks", X.BLOCKS))
def quad_to_box(spark, d):
    """Quadrilaterals to boxes; lists of points and texts are zipped to the shorter one."""
    xs, ys = F.array("x0", "x1", F.col("x1") + 3, F.col("x0") - 2), F.array("y0", F.col("y0") + 1, "y1", F.col("y1") - 4)
    return X.blocks(spark, d).select("doc_id", "seq", F.array_min(xs).alias("bx0"), F.array_min(ys).alias("by0"), F.array_max(xs).alias("bx1"), F.array_max(ys).alias("by1"))


@query("order_quad", X.with_("SELECT doc_id, seq, x0 AS tl_x, y0 AS tl_y, x1 AS br_x, y1 AS br_y FROM blocks", X.BLOCKS))
def order_quad(spark, d):
    """Corners in any order: top left has the least x + y, bottom right the greatest."""
    pt = lambda x, y: F.struct((F.col(x) + F.col(y)).alias("s"), F.col(x).alias("x"), F.col(y).alias("y"))
    q = F.array(pt("x1", "y0"), pt("x0", "y1"), pt("x1", "y1"), pt("x0", "y0"))
    return X.blocks(spark, d).select("doc_id", "seq", F.array_min(q)["x"].alias("tl_x"), F.array_min(q)["y"].alias("tl_y"), F.array_max(q)["x"].alias("br_x"), F.array_max(q)["y"].alias("br_y"))


@query("validate_homography", X.with_("SELECT doc_id, seq, (x1 - x0) * (y1 - y0) / 100000.0::DOUBLE BETWEEN 0.2 AND 5.0 AS valid FROM blocks", X.BLOCKS))
def validate_homography(spark, d):
    """A projected outline is plausible if its area is a fifth to five times the expected one and it is convex."""
    x, y = ("x0", "x1", "x1", "x0"), ("y0", "y0", "y1", "y1")
    c = F.col
    shoelace = F.abs(sum(c(x[i]) * c(y[(i + 1) % 4]) - c(x[(i + 1) % 4]) * c(y[i]) for i in range(4))) / 2
    turns = [(c(x[(i + 1) % 4]) - c(x[i])) * (c(y[(i + 2) % 4]) - c(y[(i + 1) % 4])) - (c(y[(i + 1) % 4]) - c(y[i])) * (c(x[(i + 2) % 4]) - c(x[(i + 1) % 4])) for i in range(4)]
    return X.blocks(spark, d).select("doc_id", "seq", ((shoelace / 100000.0).between(0.2, 5.0) & (F.least(*turns) > 0)).alias("valid"))


# -- labels, links, templates ---------------------------------------------------------

_LABELS = ("NPI", "Date of birth", "Phone", "Amount paid", "Zip", "Comment")


@query("link_form_field", X.with_(f"SELECT doc_id, field_seq, label, {T.guess_field_type_sql('label')} AS field_type FROM (SELECT f.doc_id, f.seq AS field_seq, {X.pick_sql(_LABELS, 'min(l.seq) % 6')} AS label FROM blocks f JOIN blocks l ON f.doc_id = l.doc_id AND f.type = 'form' AND l.type IN ('text', 'title') GROUP BY f.doc_id, f.seq)", X.BLOCKS))
def link_form_field(spark, d):
    """A field takes its type from its label."""
    b = X.blocks(spark, d)
    near = b.where("type = 'form'").alias("f").join(b.where("type in ('text', 'title')").alias("l"), F.expr("f.doc_id = l.doc_id")).groupBy("f.doc_id", F.col("f.seq").alias("field_seq")).agg(F.min("l.seq").alias("seq"))
    return near.select("doc_id", "field_seq", pick_label_column().alias("label")).withColumn("field_type", T.guess_field_type(F.col("label")))


@query("linked_fields", X.with_("SELECT l.doc_id, l.seq, array_to_string(list_sort(list(f.seq)), ',') AS fields FROM blocks l JOIN blocks f ON f.doc_id = l.doc_id AND f.type = 'form' AND l.type = 'title' GROUP BY l.doc_id, l.seq", X.BLOCKS))
def linked_fields(spark, d):
    b = X.blocks(spark, d)
    j = b.where("type = 'title'").alias("l").join(b.where("type = 'form'").alias("f"), F.expr("f.doc_id = l.doc_id"))
    return j.groupBy("l.doc_id", "l.seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f.seq")), lambda x: x.cast("string")), ",").alias("fields"))


@query("checkbox_state", X.with_("SELECT doc_id, seq, CASE WHEN confidence - 0.45::DOUBLE >= 0.55 THEN 'checked' WHEN confidence - 0.45::DOUBLE <= 0.25 THEN 'unchecked' ELSE 'ambiguous' END AS state FROM blocks WHERE type = 'form'", X.BLOCKS))
def checkbox_state(spark, d, checked: float = 0.55, unchecked: float = 0.25):
    """State by the filled share of a box, which a plug-in measures; here 0.45 below the confidence."""
    c = F.col("confidence") - 0.45
    return X.blocks(spark, d).where("type = 'form'").select("doc_id", "seq", F.when(c >= checked, "checked").when(c <= unchecked, "unchecked").otherwise("ambiguous").alias("state"))


_CENTERS = (0.1, 0.35, 0.6, 0.85)


@query("assign_columns_template", X.with_("SELECT doc_id, seq, col FROM (SELECT doc_id, seq, col, row_number() OVER (PARTITION BY doc_id, seq ORDER BY abs((x0 + x1) / 2 - cx), col) AS nth FROM blocks CROSS JOIN (VALUES (0, 255.0::DOUBLE), (1, 892.5::DOUBLE), (2, 1530.0::DOUBLE), (3, 2167.5::DOUBLE)) t(col, cx)) WHERE nth = 1", X.BLOCKS))
def assign_columns_template(spark, d):
    """The nearest of a template's column centres, the first one on a tie."""
    center = (F.col("x0") + F.col("x1")) / 2
    near = F.array(*[F.struct(F.abs(center - F.lit(c * X.PAGE_W)).alias("far"), F.lit(i).alias("col")) for i, c in enumerate(_CENTERS)])
    return X.blocks(spark, d).select("doc_id", "seq", F.array_min(near)["col"].alias("col"))


@query("template_schema")
def template_schema(spark, d):
    """Zones of a page: snapped to the form block that overlaps most (by half at least), else a block of their own."""
    pages = X.blocks(spark, d).select("doc_id").distinct()
    z = pages.crossJoin(F.broadcast(X.zones(spark).where("ord < 6")))  # six constant zones for each page
    forms = X.blocks(spark, d).where("type = 'form'").alias("b")
    over = G.iou((F.col("zx0"), F.col("zy0"), F.col("zx1"), F.col("zy1")), G.box("b."))
    scored = z.alias("z").join(forms, F.expr("z.doc_id = b.doc_id"), "left").select("z.doc_id", "zone", "b.seq", F.coalesce(over, F.lit(0.0)).alias("iou"))
    best = scored.groupBy("doc_id", "zone").agg(F.max_by(F.struct("seq", "iou"), F.struct("iou", -F.coalesce("seq", F.lit(-1)))).alias("b"))
    snapped = F.col("b.iou") >= 0.5
    return best.select("doc_id", "zone", F.when(snapped, F.col("b.seq")).alias("seq"), F.when(snapped, "snapped").otherwise("made").alias("how"), F.when(snapped, F.lit(None)).otherwise(0.4).cast("double").alias("confidence"))


_LINES = "lines AS (SELECT doc_id, x0, y0 FROM blocks WHERE type IN ('table', 'title'))"


def _snap_sql(edge: str, line: str) -> str:
    return f"coalesce((SELECT l.{line} FROM lines l WHERE l.doc_id = b.doc_id AND abs(l.{line} - b.{edge}) < 15 ORDER BY abs(l.{line} - b.{edge}), l.{line} LIMIT 1), b.{edge}) AS s{edge}"


@query("snap_lines", X.with_("SELECT doc_id, seq, " + ", ".join(_snap_sql(e, e[0] + "0") for e in ("x0", "y0", "x1", "y1")) + " FROM blocks b", X.BLOCKS, _LINES))
def snap_lines(spark, d):
    """Each edge to the page's nearest line closer than 15 pixels, the first one on ties. The lines of a page, which a plug-in finds, are here the left and upper edges of its tables and titles."""
    b = X.blocks(spark, d)
    lines = b.where("type IN ('table', 'title')").groupBy("doc_id").agg(F.array_sort(F.collect_set("x0")).alias("lx"), F.array_sort(F.collect_set("y0")).alias("ly"))

    def snapped(edge: str, lines: str):
        near = F.filter(F.transform(lines, lambda v: F.struct(F.abs(v - F.col(edge)).alias("far"), v.alias("v"))), lambda x: x["far"] < 15)
        return F.coalesce(F.array_min(near)["v"], edge).alias(f"s{edge}")

    return b.join(lines, "doc_id", "left").select("doc_id", "seq", snapped("x0", "lx"), snapped("y0", "ly"), snapped("x1", "lx"), snapped("y1", "ly"))


@query("split_by_lines", X.with_("SELECT doc_id, seq, nth, a AS y_top, b AS y_bottom FROM (SELECT doc_id, seq, unnest(range(0, 4)) AS nth, unnest([y0 + (y1 - y0) * k / 4 for k in range(0, 4)]) AS a, unnest([y0 + (y1 - y0) * k / 4 for k in range(1, 5)]) AS b FROM blocks WHERE type = 'table') WHERE b - a >= 20", X.BLOCKS))
def split_by_lines(spark, d):
    """Rows between neighbouring split points, if at least 20 pixels high."""
    at = lambda k: F.col("y0") + (F.col("y1") - F.col("y0")) * k / 4
    rows = F.array(*[F.struct(F.lit(k).alias("nth"), at(k).alias("y_top"), at(k + 1).alias("y_bottom")) for k in range(4)])
    return X.blocks(spark, d).where("type = 'table'").select("doc_id", "seq", F.explode(rows).alias("r")).select("doc_id", "seq", "r.*").where("y_bottom - y_top >= 20")


_DENSE = {"d_text": "(seq * 13 + doc_id) % 50 / 100", "d_line": "(seq * 7 + doc_id) % 40 / 1000", "d_horizontal": "(seq + doc_id) % 3 / 100", "d_vertical": "(seq * 5 + doc_id) % 4 / 100", "d_stroke": "(seq * 11 + doc_id) % 13 / 100"}
_TEXTURE = (
    "t AS (SELECT *, " + ", ".join(f"{v.rsplit(' / ')[0]} / {v.rsplit(' / ')[1]}.0::DOUBLE AS {k}" for k, v in _DENSE.items()) + ", (seq + doc_id) % 4 = 0 AS ok, greatest((x1 - x0) * (y1 - y0), 1) / 400000.0::DOUBLE AS share FROM blocks)",
    "u AS (SELECT *, CASE WHEN type = 'table' AND (share > 0.10::DOUBLE AND (d_text > 0.02::DOUBLE OR d_line > 0.015::DOUBLE) OR share < 0.05::DOUBLE AND d_line < 0.01::DOUBLE) THEN 'form' END AS fst FROM t)",
    """v AS (SELECT *, CASE
        WHEN fst IS NULL AND type = 'table' AND share > 0.35::DOUBLE THEN 'form'
        WHEN fst IS NULL AND type = 'table' AND share > 0.10::DOUBLE THEN CASE WHEN NOT ok THEN CASE WHEN d_text < 0.02::DOUBLE AND d_line < 0.01::DOUBLE THEN 'figure' ELSE 'form' END END
        WHEN type IN ('figure', 'unknown') OR type = 'table' AND share <= 0.18::DOUBLE THEN CASE
            WHEN d_stroke > 0.088::DOUBLE AND d_text < 0.059::DOUBLE AND share < 0.15::DOUBLE THEN NULL
            WHEN d_line > 0.015::DOUBLE AND d_horizontal > 0.01::DOUBLE AND d_vertical > 0.01::DOUBLE THEN CASE WHEN share > 0.35::DOUBLE OR d_text >= 0.45::DOUBLE THEN 'form' ELSE 'table' END
            WHEN d_text > 0.08::DOUBLE AND d_line < 0.02::DOUBLE THEN CASE WHEN y1 - y0 < 48 THEN 'title' ELSE 'text' END
            WHEN d_stroke > 0.088::DOUBLE AND share > 0.088::DOUBLE AND d_text < 0.036::DOUBLE THEN 'form' ELSE fst END
        ELSE fst END AS new0 FROM u)""",
    "w AS (SELECT *, CASE WHEN new0 = 'table' AND share > 0.45::DOUBLE THEN 'form' ELSE new0 END AS new1 FROM v)",
    "k AS (SELECT doc_id, seq, x0, y0, x1, y1 FROM blocks WHERE type = 'table')",
)
_COMMON = "greatest(least(w.x1, k.x1) - greatest(w.x0, k.x0), 0) * greatest(least(w.y1, k.y1) - greatest(w.y0, k.y0), 0)"


@query("texture_reclass", X.with_(f"SELECT doc_id, seq, type, CASE WHEN new1 = 'table' AND type <> 'table' AND EXISTS (SELECT 1 FROM k WHERE k.doc_id = w.doc_id AND k.seq <> w.seq AND {_COMMON} > 0.65::DOUBLE * ((w.x1 - w.x0) * (w.y1 - w.y0) + (k.x1 - k.x0) * (k.y1 - k.y0) - {_COMMON})) THEN type ELSE coalesce(new1, type) END AS new_type FROM w", X.BLOCKS, *_TEXTURE))
def texture_reclass(spark, d):
    """Types changed by the densities that a pixel plug-in reports, here made from seq and doc_id, on pages of 1000 by 400 pixels."""
    dense = {k: F.expr(v.rsplit(" / ")[0]) / F.lit(float(v.rsplit(" / ")[1])) for k, v in _DENSE.items()}
    b = X.blocks(spark, d).withColumns(dense | {"well_formed": F.expr("(seq + doc_id) % 4 = 0")})
    return texture.reclassified(b, 1000, 400).select("doc_id", "seq", "type", "new_type")


# -- tables, values and records ---------------------------------------------------------


#: Pixels within which middles of cells are of one column or row: 1.5 % of the page's width and height.
_APART = {"x": 0.015 * 2550, "y": 0.015 * 3300}


def _centre_sql(z: str) -> str:
    gap = f"m - lag(m) OVER (PARTITION BY doc_id ORDER BY m) > {_APART[z]}::DOUBLE"
    return f"""c{z} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS i, c, (c + lead(c) OVER (PARTITION BY doc_id ORDER BY c)) / 2 AS e
        FROM (SELECT doc_id, avg(m) AS c FROM (SELECT doc_id, m, sum(g) OVER (PARTITION BY doc_id ORDER BY m) AS k FROM (SELECT doc_id, m, CASE WHEN {gap} THEN 1 ELSE 0 END AS g FROM (SELECT doc_id, ({z}0 + {z}1) / 2 AS m FROM blocks))) GROUP BY doc_id, k))"""


def _cell_sql(z: str, name: str) -> str:
    of = f"FROM c{z} c WHERE c.doc_id = b.doc_id"
    return f"(SELECT i {of} ORDER BY abs(c - (b.{z}0 + b.{z}1) / 2), i LIMIT 1) AS {name}_, (SELECT count(*) {of} AND e <= b.{z}0) AS {name}_start, (SELECT count(*) {of} AND e < b.{z}1) AS {name}_end"


_CELLS = f"cells AS (SELECT doc_id, seq, text, {_cell_sql('y', 'row')}, {_cell_sql('x', 'col')} FROM blocks b)"


def cells(spark, d):
    """Boxes as cells of their page's table: nearest column and row, and the bands between neighbouring centres that they reach into."""
    b = X.blocks(spark, d)

    def centres(z: str):
        middle = b.select("doc_id", ((F.col(f"{z}0") + F.col(f"{z}1")) / 2).alias("m"))
        w = Window.partitionBy("doc_id").orderBy("m")
        k = F.sum("g").over(w)
        groups = middle.withColumn("g", F.when(F.col("m") - F.lag("m").over(w) > _APART[z], 1).otherwise(0)).withColumn("k", k).groupBy("doc_id", "k").agg(F.avg("m").alias("c"))
        return groups.groupBy("doc_id").agg(F.array_sort(F.collect_list("c")).alias(f"c{z}"))

    def placed(z: str, name: str):
        c, low, high = F.col(f"c{z}"), F.col(f"{z}0"), F.col(f"{z}1")
        near = F.array_min(F.transform(c, lambda v, i: F.struct(F.abs(v - (low + high) / 2).alias("far"), i.alias("i"))))["i"]
        # the edge above a centre is halfway to the next one; the last one has none
        edges = F.transform(F.slice(c, 1, F.size(c) - 1), lambda v, i: (v + F.get(c, i + 1)) / 2)
        upto = lambda test: F.size(F.filter(edges, test)).cast("long")
        return near.cast("long").alias(f"{name}_"), upto(lambda e: e <= low).alias(f"{name}_start"), upto(lambda e: e < high).alias(f"{name}_end")

    both = b.join(centres("x"), "doc_id").join(centres("y"), "doc_id")
    return both.select("doc_id", "seq", "text", *placed("y", "row"), *placed("x", "col"))


@query("table_cells", X.with_("SELECT * FROM cells", X.BLOCKS, _centre_sql("x"), _centre_sql("y"), _CELLS))
def table_cells(spark, d):
    return cells(spark, d)


@query("table_body", X.with_("SELECT doc_id, row_, col_, arg_max(text, seq) AS text FROM cells GROUP BY ALL", X.BLOCKS, _centre_sql("x"), _centre_sql("y"), _CELLS))
def table_body(spark, d):
    """The grid of a page: of boxes in one cell the last one's text."""
    return cells(spark, d).groupBy("doc_id", "row_", "col_").agg(F.max_by("text", "seq").alias("text"))


@query("table_header_rows", X.with_("SELECT doc_id, count(*) FILTER (lead_ok) AS n FROM (SELECT doc_id, bool_and(filled >= greatest(1, floor(0.6 * most))) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS lead_ok FROM (SELECT *, max(filled) OVER (PARTITION BY doc_id) AS most FROM (SELECT doc_id, (pos // 10) % 50 AS line, count(*) FILTER (length(token) > 3) AS filled FROM words WHERE page_id = 0 GROUP BY ALL))) GROUP BY doc_id", X.WORDS))
def table_header_rows(spark, d):
    """How many rows from the top have enough filled cells."""
    r = X.words(spark, d, True).groupBy("doc_id", (F.floor(F.col("pos") / 10) % 50).alias("line")).agg(F.count_if(F.length("token") > 3).alias("filled"))
    most = F.max("filled").over(Window.partitionBy("doc_id"))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    ok = F.bool_and(F.col("filled") >= F.greatest(F.lit(1), F.floor(F.col("most") * 0.6))).over(w)
    return r.withColumn("most", most).withColumn("ok", ok).groupBy("doc_id").agg(F.count_if(F.col("ok")).alias("n"))


@query("fuzzy_match_bbox", X.with_("SELECT doc_id, pos, score FROM (SELECT doc_id, pos, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS nth FROM (SELECT w.doc_id, w.pos, least(length(w.token), length(d.t))::DOUBLE / greatest(length(w.token), length(d.t)) AS score FROM words w JOIN (SELECT doc_id, lower(token) AS t FROM words WHERE pos = 3 AND length(token) > 0) d ON d.doc_id = w.doc_id WHERE w.page_id = 0 AND length(w.token) > 0 AND (contains(lower(w.token), d.t) OR contains(d.t, lower(w.token))))) WHERE nth = 1", X.WORDS))
def fuzzy_match_bbox(spark, d):
    """A value (here the page's fourth word) grounded in the word that contains it or lies in it, by the ratio of lengths."""
    w = X.words(spark, d, True).where(F.length("token") > 0)
    value = w.where("pos = 3").select("doc_id", F.lower("token").alias("t"))
    j = w.join(value, "doc_id").where(F.lower("token").contains(F.col("t")) | F.col("t").contains(F.lower("token")))
    score = F.least(F.length("token"), F.length("t")) / F.greatest(F.length("token"), F.length("t"))
    return j.groupBy("doc_id").agg(F.max(F.struct(score.alias("score"), (-F.col("pos")).alias("p"))).alias("b")).select("doc_id", (-F.col("b.p")).alias("pos"), "b.score")


@query("heuristic_fallback", X.with_("SELECT doc_id, seq, nxt AS value FROM (SELECT doc_id, seq, text, type, y0, lead(text) OVER (PARTITION BY doc_id ORDER BY seq) AS nxt, lead(y0) OVER (PARTITION BY doc_id ORDER BY seq) AS ny FROM blocks) WHERE type = 'title' AND nxt IS NOT NULL AND abs(ny - y0) < 500", X.BLOCKS))
def heuristic_fallback(spark, d):
    """A keyword's value is the next block, if it stands near."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    b = X.blocks(spark, d).withColumn("value", F.lead("text").over(w)).withColumn("ny", F.lead("y0").over(w))
    return b.where("type = 'title' and value is not null and abs(ny - y0) < 500").select("doc_id", "seq", "value")


@query("vlm_merge", X.with_("SELECT b.doc_id, b.seq, v.answer FROM blocks b JOIN (SELECT md5(text) AS h, 'answer ' || min(text) AS answer FROM blocks GROUP BY 1) v ON md5(b.text) = v.h WHERE b.type = 'figure'", X.BLOCKS))
def vlm_merge(spark, d):
    """Each distinct crop is asked once; the answers join back by its hash."""
    b = X.blocks(spark, d).withColumn("h", F.md5("text"))
    asked = b.where("type = 'figure'").groupBy("h").agg(F.concat(F.lit("answer "), F.min("text")).alias("answer"))
    return b.where("type = 'figure'").join(asked, "h").select("doc_id", "seq", "answer")


_DATE1, _DATE2 = r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b", r"\b([A-Z][a-z]+\s+\d{1,2},?\s+\d{4})\b"
_AUTHOR = r"(?i)by\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"


@query("doc_metadata", X.with_(f"SELECT o_orderkey, nullif(regexp_extract(s, '{_AUTHOR}', 1), '') AS author, coalesce(nullif(regexp_extract(s, '{_DATE1}', 1), ''), nullif(regexp_extract(s, '{_DATE2}', 1), '')) AS date_, CASE WHEN length(s) > 50 THEN s END AS summary FROM strings", X.STRINGS))
def doc_metadata(spark, d):
    first = lambda p: F.nullif(F.regexp_extract("s", p, 1), F.lit(""))
    return X.strings(spark, d).select("o_orderkey", first(_AUTHOR).alias("author"), F.coalesce(first(_DATE1), first(_DATE2)).alias("date_"), F.when(F.length("s") > 50, F.col("s")).alias("summary"))


@query("ui_metrics", X.with_("SELECT found, total, mean FROM (SELECT count(*) FILTER (f_npi <> '') AS found, count(*) AS total, avg((o_orderkey % 100) / 100.0::DOUBLE) FILTER (f_npi <> '') AS mean FROM fields)", X.FIELDS))
def ui_metrics(spark, d):
    """Fields with a value, all fields, and the mean confidence of those with a value."""
    some = F.col("f_npi") != ""
    return X.fields(spark, d).agg(F.count_if(some).alias("found"), F.count("*").alias("total"), F.avg(F.when(some, (F.col("o_orderkey") % 100) / F.lit(100.0))).alias("mean"))


@query("filled_schema", X.with_("SELECT doc_id, zone, text FROM (SELECT doc_id, zone, string_agg(token, ' ' ORDER BY y0, x0, pos) AS text FROM matched WHERE page_id = 0 GROUP BY ALL) WHERE text <> ''", X.WORDS, X.ZONES, MATCHED))
def filled_schema(spark, d):
    t = Z.zone_text(Z.match_unique(X.words(spark, d, True), X.zones(spark)))
    return t.where("text <> ''").select("doc_id", "zone", "text")


@query("form_outputs", X.with_("SELECT doc_id, count(*) FILTER (confidence < 0.75) AS n_fields, count(*) FILTER (confidence >= 0.75) AS n_boxes FROM blocks WHERE type = 'form' GROUP BY ALL", X.BLOCKS))
def form_outputs(spark, d):
    return X.blocks(spark, d).where("type = 'form'").groupBy("doc_id").agg(F.count_if(F.col("confidence") < 0.75).alias("n_fields"), F.count_if(F.col("confidence") >= 0.75).alias("n_boxes"))


@query("merge_group_agg", X.with_("SELECT doc_id, type, n FROM (SELECT doc_id, type, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_seq) AS nth FROM (SELECT doc_id, type, count(*) AS n, min(seq) AS first_seq FROM blocks GROUP BY ALL)) WHERE nth = 1", X.BLOCKS))
def merge_group_agg(spark, d):
    """A page's most common type, the earliest one on a tie."""
    g = X.blocks(spark, d).groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    best = g.groupBy("doc_id").agg(F.max_by(F.struct("type", "n"), F.struct("n", -F.col("first_seq"))).alias("b"))
    return best.select("doc_id", "b.type", "b.n")


@query("map_merge", X.with_("SELECT doc_id, seq, CASE WHEN seq % 2 = 0 THEN 'late' ELSE 'early' END AS kind, 'x' AS other FROM blocks", X.BLOCKS))
def map_merge(spark, d):
    """Two metadata maps as one; the later one wins."""
    early, late = F.create_map(F.lit("kind"), F.lit("early"), F.lit("other"), F.lit("x")), F.when(F.col("seq") % 2 == 0, F.create_map(F.lit("kind"), F.lit("late"))).otherwise(F.create_map().cast("map<string,string>"))
    kept = F.map_filter(early, lambda k, _: ~F.map_contains_key(F.col("late"), k))
    return X.blocks(spark, d).withColumn("late", late).withColumn("m", F.map_concat(kept, "late")).select("doc_id", "seq", F.col("m")["kind"].alias("kind"), F.col("m")["other"].alias("other"))


@query("export_blocks", X.with_("SELECT md5(doc_id::VARCHAR) AS job_id, doc_id, seq, x0 / 2550 AS left_, y0 / 3300 AS top_, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band, text FROM blocks", X.BLOCKS))
def export_blocks(spark, d):
    """Blocks as exported; the job id follows from the document, so reruns agree."""
    return X.blocks(spark, d).select(F.md5(F.col("doc_id").cast("string")).alias("job_id"), "doc_id", "seq", (F.col("x0") / 2550).alias("left_"), (F.col("y0") / 3300).alias("top_"), T.confidence_band(F.col("confidence")).alias("band"), "text")


@query("prompt_context", X.with_("SELECT doc_id, substr(string_agg(text, chr(10) ORDER BY seq), 1, 500) AS context FROM blocks GROUP BY ALL", X.BLOCKS))
def prompt_context(spark, d):
    g = X.blocks(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("b"))
    return g.select("doc_id", F.substring(F.array_join("b.text", "\n"), 1, 500).alias("context"))


@query("svg_overlay", X.with_("SELECT doc_id, seq, '<rect x=\"' || x0::INT || '\" y=\"' || y0::INT || '\" width=\"' || (x1 - x0)::INT || '\" height=\"' || (y1 - y0)::INT || '\"/>' AS svg FROM blocks", X.BLOCKS))
def svg_overlay(spark, d):
    n = lambda c: c.cast("int")
    return X.blocks(spark, d).select("doc_id", "seq", F.format_string('<rect x="%d" y="%d" width="%d" height="%d"/>', n(F.col("x0")), n(F.col("y0")), n(F.col("x1") - F.col("x0")), n(F.col("y1") - F.col("y0"))).alias("svg"))


@query("cache_stats", "SELECT count(*) AS n, count(DISTINCT sha256(text)) AS n_distinct, sum(octet_length(encode(text)))::BIGINT AS n_bytes FROM documents WHERE text IS NOT NULL")
def cache_stats(spark, d):
    """Entries of a cache keyed by content, the distinct ones, and their bytes."""
    t = X.load(spark, d, "documents").where("text is not null")
    return t.groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("c"), F.sum(F.octet_length("text")).alias("b")).agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.sum("b").alias("n_bytes"))


@query("npi_standard", X.with_("SELECT o_orderkey, f_npi AS value, length(f_npi) = 10 AND list_sum([CASE WHEN i % 2 = 0 THEN substr(v, i, 1)::INT * 2 - CASE WHEN substr(v, i, 1)::INT > 4 THEN 9 ELSE 0 END ELSE substr(v, i, 1)::INT END for i in range(1, length(v) + 1)]) % 10 = 0 AS passed FROM (SELECT o_orderkey, f_npi, '80840' || regexp_replace(f_npi, '[^0-9]', '', 'g') AS v FROM fields)", X.FIELDS))
def npi_standard(spark, d):
    """The check that the number's issuer defines: the built-in Luhn test of the prefixed number."""
    v = F.concat(F.lit("80840"), V.digits_of(F.col("f_npi")))
    return X.fields(spark, d).select("o_orderkey", F.col("f_npi").alias("value"), ((F.length("f_npi") == 10) & F.call_function("luhn_check", v)).alias("passed"))
