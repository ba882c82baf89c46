"""Words, blocks, zones, field values and strings derived from the driver tables by integer arithmetic, each with its SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

PAGE_W, PAGE_H, PAGE_WORDS = 2550, 3300, 500
TYPES = ("text", "title", "list", "table", "figure", "form", "unknown")
ZONE_TYPES = ("text", "date", "money", "npi", "phone", "checkbox", "icd", "signature")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def pick_sql(values: tuple, index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({index}) + 1]"


def words(spark: SparkSession, sf_dir: str, first_page: bool = False) -> DataFrame:
    """doc_id, page_id, pos, token, box and confidence of every word, or of those on first pages (the others are cut off before they become rows)."""
    tokens = F.split("text", r"[ \n]+")
    d = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.slice(tokens, 1, PAGE_WORDS) if first_page else tokens).alias("pos", "token"))
    x0 = (F.col("pos") % 10) * 250 + (F.col("doc_id") * 7 + F.col("pos") * 13) % 20
    y0 = F.floor(F.col("pos") / 10) % 50 * 60 + (F.col("pos") * 5) % 12
    return d.select(
        "doc_id", F.floor(F.col("pos") / PAGE_WORDS).cast("long").alias("page_id"), F.col("pos").cast("long").alias("pos"), "token", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"),
        (x0 + 20 * F.length("token")).cast("double").alias("x1"), (y0 + 40).cast("double").alias("y1"), ((40 + (F.col("doc_id") * 31 + F.col("pos") * 17) % 61) / F.lit(100.0)).alias("confidence"),
    )


WORDS = r"""words AS (
  SELECT doc_id, pos // 500 AS page_id, pos, token, x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + 20 * length(token))::DOUBLE AS x1, (y0 + 40)::DOUBLE AS y1,
         (40 + (doc_id * 31 + pos * 17) % 61) / 100.0::DOUBLE AS confidence
  FROM (SELECT doc_id, pos, token, (pos % 10) * 250 + (doc_id * 7 + pos * 13) % 20 AS x0, (pos // 10) % 50 * 60 + (pos * 5) % 12 AS y0
        FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, string_split_regex(text, '[ \n]+') AS t FROM documents WHERE text IS NOT NULL))))"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (an order is a page), seq, id, type, box, confidence and text of every block."""
    li = load(spark, sf_dir, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    x0, y0 = F.col("l_quantity").cast("long") * 40, (F.col("l_partkey") % 60) * 50
    kind = pick(TYPES, F.col("l_suppkey") % 7)
    return li.select(
        F.col("l_orderkey").alias("doc_id"), seq.cast("long").alias("seq"), kind.alias("type"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"),
        (x0 + 100 + (F.col("l_suppkey") % 10) * 80).cast("double").alias("x1"), (y0 + 20 + 15 * F.col("l_linenumber")).cast("double").alias("y1"),
        ((50 + F.col("l_partkey") % 50) / F.lit(100.0)).alias("confidence"), F.concat(F.lit("Item "), F.col("l_partkey"), F.lit(" from "), F.col("l_suppkey")).alias("text"),
    )


BLOCKS = f"""blocks AS (
  SELECT doc_id, seq, type, x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + 100 + (s % 10) * 80)::DOUBLE AS x1, (y0 + 20 + 15 * n)::DOUBLE AS y1, (50 + p % 50) / 100.0::DOUBLE AS confidence, 'Item ' || p || ' from ' || s AS text
  FROM (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS seq, {pick_sql(TYPES, 'l_suppkey % 7')} AS type,
               l_quantity::BIGINT * 40 AS x0, (l_partkey % 60) * 50 AS y0, l_suppkey AS s, l_partkey AS p, l_linenumber AS n FROM lineitem))"""


def zones(spark: SparkSession) -> DataFrame:
    """48 form zones on a grid: ord, id, label, type and pixel box. A constant table."""
    z = F.col("id")
    x0, y0 = (z % 6) * 420 + 10, F.floor(z / 6) * 400 + 20
    return spark.range(48).select(
        z.alias("ord"), F.concat(F.lit("z"), z).alias("zone"), F.concat(F.lit("Field "), z).alias("label"), pick(ZONE_TYPES, z % 8).alias("ztype"),
        x0.cast("double").alias("zx0"), y0.cast("double").alias("zy0"), (x0 + 380).cast("double").alias("zx1"), (y0 + 340).cast("double").alias("zy1"),
    )


ZONES = f"""zones AS (
  SELECT z AS ord, 'z' || z AS zone, 'Field ' || z AS label, {pick_sql(ZONE_TYPES, 'z % 8')} AS ztype, x0::DOUBLE AS zx0, y0::DOUBLE AS zy0, (x0 + 380)::DOUBLE AS zx1, (y0 + 340)::DOUBLE AS zy1
  FROM (SELECT z, (z % 6) * 420 + 10 AS x0, z // 6 * 400 + 20 AS y0 FROM range(48) t(z)))"""

#: Field values of an order as (name, Spark SQL, DuckDB SQL); every fifth one is broken by a question mark.
_FIELDS = {
    "npi": "lpad(cast((o_custkey * 7919 + 1000000007) % 10000000000 as string), 10, '0')",
    "ndc": "concat(lpad(cast(o_custkey % 100000 as string), 5, '0'), '-', lpad(cast(o_orderkey % 10000 as string), 4, '0'), '-', lpad(cast(o_orderkey % 100 as string), 2, '0'))",
    "icd": "concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(1 + o_orderkey % 26 as int), 1), lpad(cast(o_custkey % 100 as string), 2, '0'), case when o_orderkey % 3 = 0 then concat('.', cast(o_custkey % 1000 as string)) else '' end)",
    "hcpcs": "concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(1 + o_custkey % 26 as int), 1), lpad(cast(o_orderkey % 10000 as string), 4, '0'))",
    "date": "concat(cast(1 + o_orderkey % 12 as string), '/', cast(1 + o_custkey % 31 as string), '/', lpad(cast(o_orderkey % 100 as string), 2, '0'))",
    "phone": "concat('(', lpad(cast(o_custkey % 1000 as string), 3, '0'), ') ', lpad(cast(o_orderkey % 1000 as string), 3, '0'), '-', lpad(cast((o_orderkey * 7) % 10000 as string), 4, '0'))",
    "member_id": "concat('id', cast(o_custkey * 31 as string), ' ', cast(o_orderkey % 997 as string))",
    "numeric": "concat('no ', cast(o_orderkey as string))",
    "ssn": "concat(lpad(cast(o_custkey % 1000 as string), 3, '0'), '-', lpad(cast(o_orderkey % 100 as string), 2, '0'), '-', lpad(cast((o_custkey * 3) % 10000 as string), 4, '0'))",
    "zip": "concat(lpad(cast((o_custkey * 13) % 100000 as string), 5, '0'), case when o_orderkey % 2 = 0 then '-0042' else '' end)",
    "money": "concat(case when o_orderkey % 2 = 0 then '$' else '' end, cast((o_orderkey * 37) % 900000 as string), '.', lpad(cast(o_custkey % 100 as string), 2, '0'))",
    "tax_id": "concat(lpad(cast(o_custkey % 100 as string), 2, '0'), '-', lpad(cast(o_orderkey % 10000000 as string), 7, '0'))",
    "cpt": "lpad(cast((o_custkey * 17) % 100000 as string), 5, '0')",
    "state": "substr('ALAKZZCAnyTX', cast(1 + 2 * (o_orderkey % 6) as int), 2)",
}


def _broken(name: str, sql: str, place: int) -> str:
    return f"case when (o_orderkey + {place}) % 5 = 0 then concat('?', {sql}) when (o_orderkey + {place}) % 17 = 0 then '' else {sql} end as {name}"


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey with a string value of each field type."""
    return load(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", *[_broken(f"f_{n}", s, i) for i, (n, s) in enumerate(_FIELDS.items())])


FIELDS = "fields AS (SELECT o_orderkey, o_custkey, " + ", ".join(_broken(f"f_{n}", s, i).replace("as string)", "as varchar)") for i, (n, s) in enumerate(_FIELDS.items())) + " FROM orders)"

#: Strings with the faults that the text operators repair; $k is the order key.
_STRINGS = (
    "'PATIENT''S NAME (Last, First) Sharma, R' || $k",
    "'1 a. INSURED''S I.D. NUMBER ID10-' || $k || ' ,'",
    "'12345 MAIN ST CITY ' || $k",
    "'infor-' || chr(10) || 'mation of a- b ' || $k || '  two   spaces'",
    "'Total|100 , paid.Now' || chr(9) || $k || chr(13) || chr(10) || 'end' || chr(10) || chr(10) || chr(10) || 'x'",
    "'3O5 and 12O on 30 ) , 1997 H.and ' || $k",
    "'  BILLING PROVIDER Acme , Inc (No., Street) ' || $k || ':'",
    "'noise {\"a\": ' || $k || '} tail'",
    "'Name: Value ' || $k",
    "'By John Smith on 01/02/2020 amount ' || $k",
)


def _strings_sql(as_string: str) -> str:
    cases = " ".join(f"when {i} then {s.replace('$k', f'cast(o_orderkey as {as_string})')}" for i, s in enumerate(_STRINGS))
    return f"case o_orderkey % {len(_STRINGS)} {cases} end as s"


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr("o_orderkey", _strings_sql("string").replace("''", "\\'"))


STRINGS = f"strings AS (SELECT o_orderkey, {_strings_sql('varchar')} FROM orders)"


def with_(sql: str, *parts: str) -> str:
    return "WITH " + ", ".join(parts) + " " + sql
