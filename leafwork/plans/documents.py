"""Queries over whole documents: order, statistics, hierarchy, JSON and Markdown, feedback."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafwork.plans.registry import query
from leafwork.sources import fixtures as X

_ORDER = "ORDER BY y0, x0, seq"


def _in_order():
    return Window.partitionBy("doc_id").orderBy("y0", "x0", "seq")



@query("doc_reading_order", X.with_(f"SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id {_ORDER}) - 1 AS nth FROM blocks", X.BLOCKS))
def doc_reading_order(spark, d):
    return X.blocks(spark, d).select("doc_id", "seq", (F.row_number().over(_in_order()) - 1).cast("long").alias("nth"))


@query("reading_order", X.with_("SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY trunc((x0 + x1) / 2 / 200), (y0 + y1) / 2, x0, seq) - 1 AS nth FROM blocks", X.BLOCKS))
def reading_order(spark, d):
    """Columns of 200 pixels from left to right, each from top to bottom."""
    w = Window.partitionBy("doc_id").orderBy(((F.col("x0") + F.col("x1")) / 2 / 200).cast("int"), (F.col("y0") + F.col("y1")) / 2, "x0", "seq")
    return X.blocks(spark, d).select("doc_id", "seq", (F.row_number().over(w) - 1).cast("long").alias("nth"))


@query("renumber_blocks", X.with_(f"SELECT doc_id, seq, doc_id || '-' || (row_number() OVER (PARTITION BY doc_id {_ORDER}) - 1) AS id FROM blocks", X.BLOCKS))
def renumber_blocks(spark, d):
    return X.blocks(spark, d).select("doc_id", "seq", F.concat_ws("-", "doc_id", F.row_number().over(_in_order()) - 1).alias("id"))


@query("build_hierarchy", X.with_(f"SELECT doc_id, seq, CASE WHEN type <> 'title' THEN last_value(CASE WHEN type = 'title' THEN seq END IGNORE NULLS) OVER (PARTITION BY doc_id {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS parent FROM blocks", X.BLOCKS))
def build_hierarchy(spark, d):
    """Each block's parent is the latest header before it; a header has none."""
    last = F.last(F.when(F.col("type") == "title", F.col("seq")), ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    return X.blocks(spark, d).select("doc_id", "seq", F.when(F.col("type") != "title", last).alias("parent"))


@query("doc_stats", X.with_("SELECT doc_id, t.type AS type, count(b.seq) AS n, coalesce(sum(length(b.text)), 0)::BIGINT AS n_chars FROM (SELECT DISTINCT doc_id FROM blocks) CROSS JOIN (SELECT unnest(['text', 'title', 'list', 'table', 'figure', 'form', 'unknown']) AS type) t LEFT JOIN blocks b USING (doc_id, type) GROUP BY ALL", X.BLOCKS))
def doc_stats(spark, d):
    """Blocks and characters by type, with a row for each type that a document lacks."""
    g = X.blocks(spark, d).groupBy("doc_id").agg(*[F.struct(F.lit(t).alias("type"), F.count_if(F.col("type") == t).alias("n"), F.coalesce(F.sum(F.when(F.col("type") == t, F.length("text"))), F.lit(0)).cast("long").alias("n_chars")).alias(t) for t in X.TYPES])
    return g.select("doc_id", F.explode(F.array(*X.TYPES)).alias("s")).select("doc_id", "s.*")


@query("eval_counts", X.with_("SELECT type, count(*) AS n, count(*) FILTER (text <> '') AS n_text, sum(length(text))::BIGINT AS n_chars FROM blocks GROUP BY ALL", X.BLOCKS))
def eval_counts(spark, d):
    return X.blocks(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("text") != "").alias("n_text"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("api_stats", X.with_("SELECT doc_id, count(*) AS total, count(*) FILTER (type = 'form') AS extracted, count(*) FILTER (confidence > 0.8) AS sure, count(*) FILTER (type = 'form') * 100.0::DOUBLE / count(*) AS coverage FROM blocks GROUP BY ALL", X.BLOCKS))
def api_stats(spark, d):
    form = F.count_if(F.col("type") == "form")
    return X.blocks(spark, d).groupBy("doc_id").agg(F.count("*").alias("total"), form.alias("extracted"), F.count_if(F.col("confidence") > 0.8).alias("sure"), (form * 100.0 / F.count("*")).alias("coverage"))


@query("document_type", """SELECT doc_id, CASE WHEN regexp_matches(t, 'the.*grant|proposal|application') THEN 'grant_proposal' WHEN regexp_matches(t, 'invoice|bill|payment') THEN 'invoice' WHEN regexp_matches(t, 'contract|agreement') THEN 'contract' ELSE 'document' END AS document_type FROM (SELECT doc_id, lower(text) AS t FROM documents)""".replace("the.*grant", "grant"))
def document_type(spark, d):
    low = F.lower("text")
    any_of = lambda *ws: F.coalesce(low.rlike("|".join(ws)), F.lit(False))
    kind = F.when(any_of("grant", "proposal", "application"), "grant_proposal").when(any_of("invoice", "bill", "payment"), "invoice").when(any_of("contract", "agreement"), "contract").otherwise("document")
    return X.load(spark, d, "documents").select("doc_id", kind.alias("document_type"))


@query("repeating_headers", X.with_("SELECT doc_id, seq, h FROM (SELECT doc_id, seq, md5(text) AS h, count(*) OVER (PARTITION BY doc_id, md5(text)) AS n FROM blocks WHERE y0 < 3300 * 0.15 OR y1 > 3300 * 0.85) WHERE n >= 2", X.BLOCKS))
def repeating_headers(spark, d):
    """Blocks at the top or bottom of a page whose text the document has there twice or more: counted first, then joined back."""
    edge = X.blocks(spark, d).where((F.col("y0") < 495.0) | (F.col("y1") > 2805.0)).select("doc_id", "seq", F.md5("text").alias("h"))
    return edge.join(edge.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n >= 2").select("doc_id", "h"), ["doc_id", "h"], "left_semi").select("doc_id", "seq", "h")


@query("extracted_fields", X.with_("SELECT doc_id, type AS label, max_by(text, seq) AS value FROM blocks GROUP BY ALL", X.BLOCKS))
def extracted_fields(spark, d):
    """One value a label: that of the last block."""
    return X.blocks(spark, d).groupBy("doc_id", F.col("type").alias("label")).agg(F.max_by("text", "seq").alias("value"))


_MD = "CASE type WHEN 'title' THEN '# ' || text WHEN 'list' THEN '- ' || text WHEN 'table' THEN '| ' || text || ' |' WHEN 'figure' THEN '*' || text || '*' WHEN 'form' THEN '[' || text || ']' ELSE text END"


def _markdown():
    t = F.col("text")
    return F.when(F.col("type") == "title", F.concat(F.lit("# "), t)).when(F.col("type") == "list", F.concat(F.lit("- "), t)).when(F.col("type") == "table", F.concat(F.lit("| "), t, F.lit(" |"))).when(F.col("type") == "figure", F.concat(F.lit("*"), t, F.lit("*"))).when(F.col("type") == "form", F.concat(F.lit("["), t, F.lit("]"))).otherwise(t)


@query("block_markdown", X.with_(f"SELECT doc_id, seq, {_MD} AS md FROM blocks", X.BLOCKS))
def block_markdown(spark, d):
    return X.blocks(spark, d).select("doc_id", "seq", _markdown().alias("md"))


@query("assemble_markdown", X.with_(f"SELECT doc_id, string_agg({_MD}, chr(10) || chr(10) {_ORDER}) AS md FROM blocks GROUP BY ALL", X.BLOCKS))
def assemble_markdown(spark, d):
    g = X.blocks(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "seq", _markdown().alias("md")))).alias("b"))
    return g.select("doc_id", F.array_join("b.md", "\n\n").alias("md"))


@query("doc_to_json")
def doc_to_json(spark, d):
    """A document as nested JSON, blocks in order."""
    g = X.blocks(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "type", F.array("x0", "y0", "x1", "y1").alias("bbox"), "text", "confidence"))).alias("blocks"))
    return g.select("doc_id", F.to_json(F.struct("doc_id", "blocks")).alias("json"))


@query("export_content", X.with_(f"SELECT doc_id, string_agg(text, chr(10) {_ORDER}) AS content, count(*) AS n FROM blocks WHERE type IN ('text', 'title', 'list') GROUP BY ALL", X.BLOCKS))
def export_content(spark, d):
    g = X.blocks(spark, d).where(F.col("type").isin("text", "title", "list")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "seq", "text"))).alias("b"), F.count("*").alias("n"))
    return g.select("doc_id", F.array_join("b.text", "\n").alias("content"), "n")


@query("page_titles", r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def page_titles(spark, d):
    return X.load(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


# -- feedback: events stand for the correction log --------------------------------


def corrections(spark, d):
    e = X.load(spark, d, "events")
    return e.select("event_id", F.col("user_id").alias("block_id"), F.col("event_type").alias("source"), F.least(F.lit(1.0), F.col("value") / 100).alias("new_confidence"))


@query("corrections_scan", "SELECT event_id, user_id AS block_id, event_type AS source, least(1.0, value / 100) AS new_confidence FROM events")
def corrections_scan(spark, d):
    return corrections(spark, d)


@query("auto_tune", "SELECT source, least(0.9, greatest(0.4, 0.9::DOUBLE * median(least(1.0::DOUBLE, value / 100))))::DOUBLE AS threshold FROM (SELECT *, event_type AS source FROM events) GROUP BY source")
def auto_tune(spark, d):
    """The threshold that follows from the median corrected confidence of each source, between 0.4 and 0.9."""
    return corrections(spark, d).groupBy("source").agg(F.least(F.lit(0.9), F.greatest(F.lit(0.4), F.lit(0.9) * F.median("new_confidence"))).alias("threshold"))


@query("threshold_merge", "SELECT 'low_confidence_threshold' AS name, 0.613366::DOUBLE AS value UNION ALL SELECT 'high_confidence_threshold', 0.9::DOUBLE")
def threshold_merge(spark, d):
    """Stored thresholds over the defaults; what is no number is ignored."""
    defaults = spark.createDataFrame([("low_confidence_threshold", 0.72), ("high_confidence_threshold", 0.9)], "name string, base double")
    stored = spark.createDataFrame([("low_confidence_threshold", "0.613366"), ("high_confidence_threshold", "high")], "name string, text string")
    return defaults.join(stored, "name", "left").select("name", F.coalesce(F.col("text").try_cast("double"), F.col("base")).alias("value"))


@query("train_val_split", "SELECT part, count(*) AS n FROM (SELECT CASE WHEN nth <= floor(total * 0.8) THEN 'train' ELSE 'val' END AS part FROM (SELECT row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS nth, count(*) OVER () AS total FROM documents)) GROUP BY part")
def train_val_split(spark, d):
    """An exact 80 to 20 split by rank of a hash: the rank comes from counts of 4,096 hash buckets, and only within buckets by sorting."""
    docs = X.load(spark, d, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h")).withColumn("bucket", F.substring("h", 1, 3))
    counts = docs.groupBy("bucket").agg(F.count("*").alias("c"))
    before = counts.select("bucket", (F.sum("c").over(Window.orderBy("bucket")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("total"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "doc_id"))
    ranked = docs.withColumn("nth", nth).join(F.broadcast(before), "bucket")
    part = F.when(F.col("before") + F.col("nth") <= F.floor(F.col("total") * F.lit(0.8)), "train").otherwise("val")
    return ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("cluster_positions", X.with_("SELECT doc_id, cluster, min(x0) AS low, max(x0) AS high, count(*) AS n FROM (SELECT doc_id, x0, (sum(brk) OVER (PARTITION BY doc_id ORDER BY x0, seq))::BIGINT AS cluster FROM (SELECT doc_id, seq, x0, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id ORDER BY x0, seq) > 60 THEN 1 ELSE 0 END AS brk FROM blocks)) GROUP BY ALL", X.BLOCKS))
def cluster_positions(spark, d):
    """Left edges in clusters: a gap of more than 60 pixels to the edge before opens a new one."""
    w = Window.partitionBy("doc_id").orderBy("x0", "seq")
    brk = F.when(F.col("x0") - F.lag("x0").over(w) > 60, 1).otherwise(0)
    c = X.blocks(spark, d).withColumn("brk", brk).withColumn("cluster", F.sum("brk").over(w))
    return c.groupBy("doc_id", "cluster").agg(F.min("x0").alias("low"), F.max("x0").alias("high"), F.count("*").alias("n"))
