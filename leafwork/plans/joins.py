"""Queries that match words, zones, labels, fields and records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafwork.functions import text as T
from leafwork.functions import validate as V
from leafwork.operators import zones as Z
from leafwork.plans.registry import query
from leafwork.sources import fixtures as X


@query("scan_words", X.with_("SELECT * FROM words", X.WORDS))
def scan_words(spark, d):
    return X.words(spark, d)


@query("scale_words", X.with_("SELECT doc_id, pos, x0 * (2550.0 / 612.0)::DOUBLE AS sx0, y0 * (3300.0 / 792.0)::DOUBLE AS sy0 FROM words", X.WORDS))
def scale_words(spark, d):
    """Points to pixels, by the page's size in both; a page without a size keeps its scale."""
    return X.words(spark, d).select("doc_id", "pos", (F.col("x0") * F.when(F.lit(612.0) > 0, F.lit(2550.0 / 612.0)).otherwise(1.0)).alias("sx0"), (F.col("y0") * F.lit(3300.0 / 792.0)).alias("sy0"))


@query("digital_min_words", X.with_("SELECT doc_id, page_id, pos, token FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, page_id) AS n FROM words WHERE trim(token) <> '') WHERE n >= 30", X.WORDS))
def digital_min_words(spark, d):
    """Words of pages whose text layer has at least 30 words."""
    w = X.words(spark, d).where(F.trim("token") != "")
    full = w.groupBy("doc_id", "page_id").agg(F.count("*").alias("n")).where("n >= 30")
    return w.join(full, ["doc_id", "page_id"], "left_semi").select("doc_id", "page_id", "pos", "token")


@query("systematic_sample", X.with_("SELECT doc_id, page_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY pos) AS nth FROM words WHERE length(token) BETWEEN 3 AND 20) WHERE (nth - 1) % 5 = 0", X.WORDS))
def systematic_sample(spark, d):
    nth = F.row_number().over(Window.partitionBy("doc_id", "page_id").orderBy("pos"))
    return X.words(spark, d).where(F.length("token").between(3, 20)).withColumn("nth", nth).where((F.col("nth") - 1) % 5 == 0).select("doc_id", "page_id", "pos")


_IN = "ax BETWEEN zx0 AND zx1 AND ay BETWEEN zy0 AND zy1"
_NEAR = "ax BETWEEN px0 AND px1 AND ay BETWEEN py0 AND py1"
_PADDED = """(SELECT *, greatest(0, zx0 - greatest(trunc((zx1 - zx0) * 0.15::DOUBLE), 8)) AS px0, greatest(0, zy0 - greatest(trunc((zy1 - zy0) * 0.15::DOUBLE), 8)) AS py0,
  least(2550, zx1 + greatest(trunc((zx1 - zx0) * 0.15::DOUBLE), 8)) AS px1, least(3300, zy1 + greatest(trunc((zy1 - zy0) * 0.15::DOUBLE), 8)) AS py1 FROM zones)"""
MATCHED = f"""matched AS (SELECT * FROM (SELECT w.*, z.zone, z.ord, CASE WHEN {_IN} THEN 1 ELSE 2 END AS priority,
  row_number() OVER (PARTITION BY w.doc_id, w.pos ORDER BY CASE WHEN {_IN} THEN 1 ELSE 2 END, CASE WHEN {_IN} THEN (zx1 - zx0) * (zy1 - zy0) ELSE (px1 - px0) * (py1 - py0) END, z.ord) AS nth
  FROM (SELECT *, (x0 + x1) / 2 AS ax, y0 + least(2.0, 0.2::DOUBLE * greatest(1.0, y1 - y0)) AS ay FROM words) w JOIN {_PADDED} z ON {_NEAR}) WHERE nth = 1)"""


@query("zone_match_unique", X.with_("SELECT doc_id, pos, zone, priority FROM matched", X.WORDS, X.ZONES, MATCHED))
def zone_match_unique(spark, d):
    return Z.match_unique(X.words(spark, d), X.zones(spark)).select("doc_id", "pos", "zone", "priority")


@query("zone_match_overlap", X.with_(f"SELECT doc_id, pos, zone FROM words JOIN {_PADDED} z ON least(x1, px1) > greatest(x0, px0) AND least(y1, py1) > greatest(y0, py0)", X.WORDS, X.ZONES))
def zone_match_overlap(spark, d):
    return Z.match_overlap(X.words(spark, d), X.zones(spark)).select("doc_id", "pos", "zone")


_ZTEXT = "SELECT doc_id, page_id, zone, string_agg(token, ' ' ORDER BY y0, x0, pos) AS text, count(*) AS n_words FROM matched GROUP BY ALL"


@query("zone_text", X.with_(_ZTEXT, X.WORDS, X.ZONES, MATCHED))
def zone_text(spark, d):
    return Z.zone_text(Z.match_unique(X.words(spark, d), X.zones(spark))).drop("total")


@query("zone_reality_check", X.with_("SELECT doc_id, page_id, zone FROM (SELECT *, count(*) FILTER (length(text) >= 3) OVER (PARTITION BY doc_id, page_id) AS good FROM (" + _ZTEXT + ")) WHERE good >= 10", X.WORDS, X.ZONES, MATCHED))
def zone_reality_check(spark, d):
    """Zones of pages with at least ten zones of three characters or more; on other pages the template did not fit."""
    t = Z.zone_text(Z.match_unique(X.words(spark, d), X.zones(spark)))
    good = F.count_if(F.length("text") >= 3).over(Window.partitionBy("doc_id", "page_id"))
    return t.withColumn("good", good).where("good >= 10").select("doc_id", "page_id", "zone")


@query("form_coverage", X.with_(f"""SELECT doc_id, count(*) AS n_fields, count(*) FILTER (value <> '') AS n_filled, count(*) FILTER (value <> '' AND length(value) >= 3) AS n_valid, count(*) FILTER (value <> '')::DOUBLE / 48 AS coverage
FROM (SELECT doc_id, {T.strip_labels_sql('text', False)} AS value FROM (SELECT doc_id, zone, string_agg(token, ' ' ORDER BY y0, x0, pos) AS text FROM matched WHERE page_id = 0 GROUP BY ALL)) GROUP BY doc_id""", X.WORDS, X.ZONES, MATCHED))
def form_coverage(spark, d):
    """The flagship: for each document's first page, which zones hold text, how many of them have a plausible value, and what share is filled."""
    t = Z.zone_text(Z.match_unique(X.words(spark, d, True), X.zones(spark))).withColumn("value", T.strip_labels_zone(F.col("text")))
    filled = F.col("value") != ""
    return t.groupBy("doc_id").agg(F.count("*").alias("n_fields"), F.count_if(filled).alias("n_filled"), F.count_if(filled & (F.length("value") >= 3)).alias("n_valid"), (F.count_if(filled) / F.lit(48.0)).alias("coverage"))


@query("text_confidence", X.with_("SELECT doc_id, page_id, sum(CAST(round(confidence * 100) AS BIGINT))::BIGINT AS total, count(*) AS n FROM words GROUP BY ALL", X.WORDS))
def text_confidence(spark, d):
    """Mean confidence as exact sum of hundredths and count, confidences clamped to 0 and 1."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    return X.words(spark, d).groupBy("doc_id", "page_id").agg(F.sum(F.round(c * 100).cast("long")).alias("total"), F.count("*").alias("n"))


@query("words_to_block", X.with_("SELECT doc_id, page_id, (pos // 10) % 50 AS line, string_agg(token, ' ' ORDER BY x0, pos) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words GROUP BY ALL", X.WORDS))
def words_to_block(spark, d):
    """Lines of words as blocks: text in x order and the hull of the boxes."""
    w = X.words(spark, d).withColumn("line", F.floor(F.col("pos") / 10) % 50)
    g = w.groupBy("doc_id", "page_id", "line").agg(F.array_sort(F.collect_list(F.struct("x0", "pos", "token"))).alias("w"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return g.select("doc_id", "page_id", "line", F.array_join("w.token", " ").alias("text"), "x0", "y0", "x1", "y1")


@query("band_text", X.with_("SELECT doc_id, page_id, string_agg(lower(token), ' ' ORDER BY y0, x0, pos) AS text FROM words WHERE y0 < 3300 * 0.15 GROUP BY ALL", X.WORDS))
def band_text(spark, d):
    """Lower-cased text of the top band of each page."""
    g = X.words(spark, d).where(F.col("y0") < 495.0).groupBy("doc_id", "page_id").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "pos", "token"))).alias("w"))
    return g.select("doc_id", "page_id", F.lower(F.array_join("w.token", " ")).alias("text"))


# -- labels and fields: form blocks are fields, text-like blocks are labels ------

_COST = """greatest(0.0, f.x0 - l.x1) + abs((f.y0 + f.y1) / 2 - (l.y0 + l.y1) / 2) * 0.8::DOUBLE + (1.0 - least(1.0, greatest(0.0, least(f.y1, l.y1) - greatest(f.y0, l.y0)) / greatest(f.y1 - f.y0, 1.0))) * greatest(f.y1 - f.y0, 1.0) * 1.2::DOUBLE + CASE WHEN l.x0 >= f.x1 THEN 150.0 ELSE 0.0 END"""
_SIDES = "blocks f JOIN blocks l ON f.doc_id = l.doc_id AND f.type = 'form' AND l.type IN ('text', 'title')"


def _sides(spark, d):
    b = X.blocks(spark, d)
    return b.where("type = 'form'").alias("f").join(b.where("type in ('text', 'title')").alias("l"), F.col("f.doc_id") == F.col("l.doc_id"))


def label_cost_column():
    height = F.greatest(F.expr("f.y1 - f.y0"), F.lit(1.0))
    shared = F.greatest(F.lit(0.0), F.expr("least(f.y1, l.y1) - greatest(f.y0, l.y0)")) / height
    gap, off = F.greatest(F.lit(0.0), F.expr("f.x0 - l.x1")), F.abs(F.expr("(f.y0 + f.y1) / 2 - (l.y0 + l.y1) / 2"))
    return gap + off * 0.8 + (F.lit(1.0) - F.least(F.lit(1.0), shared)) * height * 1.2 + F.when(F.expr("l.x0 >= f.x1"), 150.0).otherwise(0.0)


@query("label_cost", X.with_(f"SELECT f.doc_id, f.seq AS field_seq, l.seq AS label_seq, {_COST} AS cost FROM {_SIDES}", X.BLOCKS))
def label_cost(spark, d):
    return _sides(spark, d).select("f.doc_id", F.col("f.seq").alias("field_seq"), F.col("l.seq").alias("label_seq"), label_cost_column().alias("cost"))


_NEAREST = f"""SELECT doc_id, field_seq, label_seq, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_seq ORDER BY score, label_seq) AS nth FROM (
 SELECT doc_id, field_seq, label_seq, greatest(CASE WHEN dist < -5 THEN mid ELSE dist END, 0.0) + CASE WHEN dist < -5 THEN 40.0 ELSE 0.0 END + (1.0 - least(ov, 1.0)) * 25.0 AS score FROM (
  SELECT f.doc_id, f.seq AS field_seq, l.seq AS label_seq, f.x0 - l.x1 AS dist, abs((f.y0 + f.y1) / 2 - (l.y0 + l.y1) / 2) AS mid, greatest(0.0, least(f.y1, l.y1) - greatest(f.y0, l.y0)) / greatest(f.y1 - f.y0, 1) AS ov,
         l.y1 <= f.y0 AND f.y0 - l.y1 < greatest(f.y1 - f.y0, 1) AS above FROM {_SIDES}) WHERE (ov >= 0.25 OR above) AND NOT (dist < 0 AND dist >= -5))) WHERE nth = 1"""


@query("nearest_label", X.with_(_NEAREST, X.BLOCKS))
def nearest_label(spark, d):
    """The label with the lowest score on the field's page, the first one on a tie."""
    height = F.greatest(F.expr("f.y1 - f.y0"), F.lit(1.0))
    s = _sides(spark, d).select(
        "f.doc_id", F.col("f.seq").alias("field_seq"), F.col("l.seq").alias("label_seq"), F.expr("f.x0 - l.x1").alias("dist"), F.abs(F.expr("(f.y0 + f.y1) / 2 - (l.y0 + l.y1) / 2")).alias("mid"),
        (F.greatest(F.lit(0.0), F.expr("least(f.y1, l.y1) - greatest(f.y0, l.y0)")) / height).alias("ov"), (F.expr("l.y1 <= f.y0") & (F.expr("f.y0 - l.y1") < height)).alias("above"),
    ).where("(ov >= 0.25 or above) and not (dist < 0 and dist >= -5)")
    turned = F.col("dist") < -5
    score = F.greatest(F.when(turned, F.col("mid")).otherwise(F.col("dist")), F.lit(0.0)) + F.when(turned, 40.0).otherwise(0.0) + (F.lit(1.0) - F.least("ov", F.lit(1.0))) * 25.0
    best = s.withColumn("score", score).groupBy("doc_id", "field_seq").agg(F.min(F.struct("score", "label_seq")).alias("b"))
    return best.select("doc_id", "field_seq", "b.label_seq", "b.score")


@query("figure_caption", X.with_("SELECT doc_id, figure_seq, caption_seq FROM (SELECT f.doc_id, f.seq AS figure_seq, l.seq AS caption_seq, row_number() OVER (PARTITION BY f.doc_id, f.seq ORDER BY l.seq) AS nth FROM blocks f JOIN blocks l ON f.doc_id = l.doc_id AND f.type = 'figure' AND l.type = 'text' AND l.y0 >= f.y1 AND l.y0 - f.y1 <= 40) WHERE nth = 1", X.BLOCKS))
def figure_caption(spark, d):
    b = X.blocks(spark, d)
    near = b.where("type = 'figure'").alias("f").join(b.where("type = 'text'").alias("l"), F.expr("f.doc_id = l.doc_id and l.y0 >= f.y1 and l.y0 - f.y1 <= 40"))
    return near.groupBy("f.doc_id", F.col("f.seq").alias("figure_seq")).agg(F.min("l.seq").alias("caption_seq"))


@query("attach_digital_text", X.with_("SELECT b.doc_id, b.seq, count(*) AS n_words, string_agg(w.token, ' ' ORDER BY w.pos) AS words FROM blocks b JOIN words w ON w.doc_id = b.doc_id AND w.page_id = 0 AND (w.x0 + w.x1) / 2 BETWEEN b.x0 - 2 AND b.x1 + 2 AND (w.y0 + w.y1) / 2 BETWEEN b.y0 - 2 AND b.y1 + 2 GROUP BY ALL", X.BLOCKS, X.WORDS))
def attach_digital_text(spark, d):
    """Words of the page whose middle lies in a block, within two pixels."""
    w = X.words(spark, d, True).alias("w")
    on = "w.doc_id = b.doc_id and (w.x0 + w.x1) / 2 between b.x0 - 2 and b.x1 + 2 and (w.y0 + w.y1) / 2 between b.y0 - 2 and b.y1 + 2"
    g = X.blocks(spark, d).alias("b").join(w, F.expr(on)).groupBy("b.doc_id", "b.seq").agg(F.count("*").alias("n_words"), F.array_sort(F.collect_list(F.struct("w.pos", "w.token"))).alias("t"))
    return g.select("doc_id", "seq", "n_words", F.array_join("t.token", " ").alias("words"))


# -- records --------------------------------------------------------------------


def _candidates(spark, d):
    """Two sources for each of three business fields of an order."""
    f = X.fields(spark, d)
    rows = F.array(*[F.struct(F.lit(b).alias("field"), F.lit(i).alias("place"), F.col(c).alias("raw"), (((F.col("o_orderkey") * (7 + i)) % 100) / F.lit(100.0)).alias("confidence")) for b, cs in _SOURCES.items() for i, c in enumerate(cs)])
    return f.select("o_orderkey", F.explode(rows).alias("r")).select("o_orderkey", "r.*")


_SOURCES = {"billing_npi": ("f_npi", "f_cpt"), "phone": ("f_phone", "f_ssn"), "total_charge": ("f_money", "f_numeric")}
_CAND = "cand AS (" + " UNION ALL ".join(f"SELECT o_orderkey, '{b}' AS field, {i} AS place, {c} AS raw, ((o_orderkey * {7 + i}) % 100) / 100.0::DOUBLE AS confidence FROM fields" for b, cs in _SOURCES.items() for i, c in enumerate(cs)) + ")"
_PICK = f"SELECT o_orderkey, field, value, place, confidence FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey, field ORDER BY confidence DESC, place) AS nth FROM (SELECT *, {T.strip_labels_sql('raw', True)} AS value FROM cand) WHERE value <> '') WHERE nth = 1"


def picked(spark, d):
    c = _candidates(spark, d).withColumn("value", T.strip_labels_business(F.col("raw"))).where("value <> ''")
    best = c.groupBy("o_orderkey", "field").agg(F.max_by(F.struct("value", "place", "confidence"), F.struct("confidence", -F.col("place"))).alias("b"))
    return best.select("o_orderkey", "field", "b.*")


@query("pick_source", X.with_(_PICK, X.FIELDS, _CAND))
def pick_source(spark, d):
    """Of a business field's sources the cleaned value of highest confidence, the first one on a tie."""
    return picked(spark, d)


@query("business_coverage", X.with_(f"SELECT o_orderkey, count(*) AS n_filled, count(*)::DOUBLE / 3 AS coverage FROM ({_PICK}) GROUP BY ALL", X.FIELDS, _CAND))
def business_coverage(spark, d):
    return picked(spark, d).groupBy("o_orderkey").agg(F.count("*").alias("n_filled"), (F.count("*") / F.lit(3.0)).alias("coverage"))


_BKIND = {"billing_npi": "npi", "phone": "phone", "total_charge": "money"}
_BUSINESS = " UNION ALL ".join(f"SELECT o_orderkey, field, value, passed, CASE WHEN passed THEN normalized ELSE value END AS final, CASE WHEN passed THEN greatest(confidence, 0.75::DOUBLE) ELSE least(confidence, 0.55::DOUBLE) END AS confidence, CASE WHEN NOT passed THEN 'failed_{k}' END AS note FROM (SELECT *, {V.first_family_sql(k, 'value')} FROM p WHERE field = '{b}')" for b, k in _BKIND.items())


@query("business_map", X.with_(_BUSINESS, X.FIELDS, _CAND, f"p AS ({_PICK})"))
def business_map(spark, d):
    """Picked values checked by their field's validator; the verdict moves the confidence."""
    p = picked(spark, d)
    r = F.coalesce(*[F.when(F.col("field") == b, V.first_family(k, F.col("value"))) for b, k in _BKIND.items()])
    kind = F.coalesce(*[F.when(F.col("field") == b, F.lit(k)) for b, k in _BKIND.items()])
    ok = F.col("r.passed")
    return p.withColumn("r", r).select("o_orderkey", "field", "value", ok.alias("passed"), F.when(ok, F.col("r.normalized")).otherwise(F.col("value")).alias("final"), F.when(ok, F.greatest("confidence", F.lit(0.75))).otherwise(F.least("confidence", F.lit(0.55))).alias("confidence"), F.when(~ok, F.concat(F.lit("failed_"), kind)).alias("note"))


_COMPARE = "SELECT t.o_orderkey, t.field, lower(trim(coalesce(p, ''))) = lower(trim(v)) AS same FROM (SELECT o_orderkey, 'zip' AS field, f_zip AS v, CASE WHEN o_orderkey % 7 = 0 THEN 'wrong' ELSE ' ' || f_zip || ' ' END AS p FROM fields UNION ALL SELECT o_orderkey, 'icd', f_icd, lower(f_icd) FROM fields) t"


def compared(spark, d):
    f = X.fields(spark, d)
    truth = f.select("o_orderkey", F.explode(F.array(F.struct(F.lit("zip").alias("field"), F.col("f_zip").alias("v")), F.struct(F.lit("icd").alias("field"), F.col("f_icd").alias("v")))).alias("t")).select("o_orderkey", "t.*")
    noisy = F.when(F.col("o_orderkey") % 7 == 0, "wrong").otherwise(F.concat(F.lit(" "), "f_zip", F.lit(" ")))
    pred = f.select("o_orderkey", F.explode(F.array(F.struct(F.lit("zip").alias("field"), noisy.alias("p")), F.struct(F.lit("icd").alias("field"), F.lower("f_icd").alias("p")))).alias("t")).select("o_orderkey", "t.*")
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return truth.join(pred, ["o_orderkey", "field"], "left").select("o_orderkey", "field", (norm("p") == norm("v")).alias("same"))


@query("compare_fields", X.with_(_COMPARE, X.FIELDS))
def compare_fields(spark, d):
    return compared(spark, d)


@query("eval_accuracy", X.with_(f"SELECT o_orderkey, count(*) FILTER (same)::DOUBLE / count(*) AS accuracy, count(*) AS n FROM ({_COMPARE}) GROUP BY ALL", X.FIELDS))
def eval_accuracy(spark, d):
    return compared(spark, d).groupBy("o_orderkey").agg((F.count_if(F.col("same")) / F.count("*")).alias("accuracy"), F.count("*").alias("n"))


@query("cross_validate", X.with_("SELECT o_orderkey, abs(total - line) > 0.01 AS differs FROM (SELECT o_orderkey, TRY_CAST(regexp_replace(f_money, '[^0-9.]', '', 'g') AS DOUBLE) AS total, ((o_orderkey * 37) % 900000)::DOUBLE AS line FROM fields) WHERE total IS NOT NULL", X.FIELDS))
def cross_validate(spark, d):
    total = F.regexp_replace("f_money", "[^0-9.]", "").try_cast("double")
    f = X.fields(spark, d).select("o_orderkey", total.alias("total"), ((F.col("o_orderkey") * 37) % 900000).cast("double").alias("line")).where("total is not null")
    return f.select("o_orderkey", (F.abs(F.col("total") - F.col("line")) > 0.01).alias("differs"))
