"""Queries of the text functions and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwork.functions import text as T
from leafwork.functions import validate as V
from leafwork.plans.registry import query
from leafwork.sources import fixtures as X

# -- validators ---------------------------------------------------------------


def _validators() -> None:
    for kind in V.FAMILY_1:
        query(f"v_{kind}", X.with_(f"SELECT o_orderkey, f_{kind} AS value, {V.first_family_sql(kind, f'f_{kind}')} FROM fields", X.FIELDS))(
            lambda spark, d, k=kind: X.fields(spark, d).select("o_orderkey", F.col(f"f_{k}").alias("value"), V.first_family(k, F.col(f"f_{k}")).alias("r")).select("o_orderkey", "value", "r.*")
        )
    for kind in V.FAMILY_2:
        query(f"v2_{kind}", X.with_(f"SELECT o_orderkey, f_{kind} AS value, {V.second_family_sql(kind, f'f_{kind}')} FROM fields", X.FIELDS))(
            lambda spark, d, k=kind: X.fields(spark, d).select("o_orderkey", F.col(f"f_{k}").alias("value"), V.second_family(k, F.col(f"f_{k}")).alias("r")).select("o_orderkey", "value", "r.*")
        )


_validators()

_THIRD = ", ".join(f"(f_{k} = '' OR regexp_matches(upper(trim(f_{k})), '{p}')) AS ok_{k}" for k, p in V.PATTERNS_3.items())


@query("v3_validate", X.with_(f"SELECT o_orderkey, {_THIRD}, true AS ok_other FROM fields", X.FIELDS))
def v3_validate(spark, d):
    return X.fields(spark, d).select("o_orderkey", *[V.third_family(k, F.col(f"f_{k}")).alias(f"ok_{k}") for k in V.PATTERNS_3], V.third_family("other", F.lit("x")).alias("ok_other"))


_KINDS = ("npi", "zip", "money", "ssn", "other")


@query("validate_field", X.with_("SELECT o_orderkey, kind, passed, normalized, reason FROM (" + " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS kind, {V.first_family_sql(k, f'f_{k}')} FROM fields WHERE o_orderkey % 5 = {i}" for i, k in enumerate(_KINDS[:4])) + " UNION ALL SELECT o_orderkey, 'other' AS kind, false AS passed, NULL AS normalized, 'unknown_validator' AS reason FROM fields WHERE o_orderkey % 5 = 4)", X.FIELDS))
def validate_field(spark, d):
    """The validator is chosen by a column."""
    f = X.fields(spark, d).withColumn("kind", X.pick(_KINDS, F.col("o_orderkey") % 5))
    r = F.coalesce(*[F.when(F.col("kind") == k, V.first_family(k, F.col(f"f_{k}"))) for k in _KINDS[:4]], V.first_family("other", F.lit("")))
    return f.select("o_orderkey", "kind", r.alias("r")).select("o_orderkey", "kind", "r.*")


_LABELS = ("NPI number", "Drug name", "Diagnosis", "Procedure code", "DOB", "Telephone", "Amount paid", "Zip", "Social security", "Charge", "Comment", "Tax")


@query("guess_field_type", f"SELECT o_orderkey, label, {T.guess_field_type_sql('label')} AS field_type FROM (SELECT o_orderkey, {X.pick_sql(_LABELS, f'o_orderkey % {len(_LABELS)}')} AS label FROM orders)")
def guess_field_type(spark, d):
    label = X.pick(_LABELS, F.col("o_orderkey") % len(_LABELS))
    return X.load(spark, d, "orders").select("o_orderkey", label.alias("label")).withColumn("field_type", T.guess_field_type(F.col("label")))


# -- text ---------------------------------------------------------------------


def _on_strings(name: str, function, sql: str) -> None:
    query(name, X.with_(f"SELECT o_orderkey, {sql} AS out FROM strings", X.STRINGS))(lambda spark, d: X.strings(spark, d).select("o_orderkey", function(F.col("s")).alias("out")))


def _re(s: str, p: str, new: str) -> str:
    return f"regexp_replace({s}, '{p}', '{new}', 'g')"


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_HYPHEN = _re(_re("s", r"([a-zA-Z])-\s*\n\s*([a-z])", r"\1\2"), r"([a-zA-Z])-\s+([a-z])", r"\1\2")


def _clean(s: str) -> str:
    return "translate(" + _STRIP.format(_re(_re(s, " +", " "), r"\n\n+", r"\n\n").replace(r"'\n\n', 'g'", "chr(10) || chr(10), 'g'")) + ", '|0', 'lO')"


def _spaces(s: str) -> str:
    return _re(_re(_re(s, r"\t", " "), " +", " "), r"\r\n?", "@").replace("'@'", "chr(10)")


def _repair() -> str:
    t = "translate(s, '|', 'l')"
    for p, new in ((r"\s+([.,;:!?])", r"\1"), (r"([.,;:!?])\s*([A-Z])", r"\1 \2"), (r"([A-Z])\.([a-z])", r"\1. \2"), (r"(\d)O(\d)", r"\g0\2"), (r"(\d{1,2})O\b", r"\g0"), (r"\b(\d{1,2})\s*\)\s*,\s*(\d{4})\b", r"\1, \2")):
        t = _re(t, p, new.replace(r"\g", r"\1"))
    lines = f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), chr(10))"
    return _STRIP.format(_re(f"replace({lines}, '-' || chr(10), '')", " +", " "))


_on_strings("fix_hyphenation", T.fix_hyphenation, _HYPHEN)
_on_strings("clean_text", T.clean_text, _clean("s"))
_on_strings("normalize_ws", T.normalize_whitespace, _spaces("s"))
_on_strings("postprocess_text", lambda s: T.strip(T.normalize_whitespace(T.clean_text(T.fix_hyphenation(s)))), _STRIP.format(_spaces(_clean(_HYPHEN))))
_on_strings("ocr_repair", T.ocr_repair, _repair())
_on_strings("strip_labels_business", T.strip_labels_business, T.strip_labels_sql("s", True))
_on_strings("strip_labels_zone", T.strip_labels_zone, T.strip_labels_sql("s", False))
_on_strings("has_value", lambda s: ~F.lower(T.strip(F.coalesce(s, F.lit("")))).isin("", "null", "none", "n/a", "-"), f"lower({_STRIP.format('s')}) NOT IN ('', 'null', 'none', 'n/a', '-')")
_on_strings("json_salvage", lambda s: F.get_json_object(F.regexp_extract(s, r"(?s)\{.*\}", 0), "$.a").cast("long"), r"TRY_CAST(json_extract_string(CASE WHEN regexp_matches(s, '(?s)\{.*\}') THEN regexp_extract(s, '(?s)\{.*\}') END, '$.a') AS BIGINT)")
_on_strings("content_hash", lambda s: F.sha2(s, 256), "sha256(s)")


@query("noise_score", X.with_(r"SELECT o_orderkey, length(regexp_replace(s, '[^\p{L}\p{N}]', '', 'g'))::DOUBLE / greatest(length(s), 1) AS alnum_ratio, length(s) <= 2 OR length(regexp_replace(s, '[^\p{L}\p{N}]', '', 'g'))::DOUBLE / greatest(length(s), 1) < 0.55 AS noisy FROM strings", X.STRINGS))
def noise_score(spark, d):
    ratio = F.length(F.regexp_replace("s", r"[^\p{L}\p{N}]", "")).cast("double") / F.greatest(F.length("s"), F.lit(1))
    return X.strings(spark, d).select("o_orderkey", ratio.alias("alnum_ratio"), ((F.length("s") <= 2) | (ratio < 0.55)).alias("noisy"))


_KEY, _VALUE = r"^([^:]+):\s*(.+)$", r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+([A-Z0-9@.]+)$"


@query("kv_pairs", X.with_(rf"SELECT o_orderkey, trim(CASE WHEN regexp_matches(t, '{_KEY}') THEN regexp_extract(t, '{_KEY}', 1) ELSE regexp_extract(t, '{_VALUE}', 1) END) AS k, trim(CASE WHEN regexp_matches(t, '{_KEY}') THEN regexp_extract(t, '{_KEY}', 2) ELSE regexp_extract(t, '{_VALUE}', 2) END) AS v FROM (SELECT o_orderkey, {_STRIP.format('s')} AS t FROM strings) WHERE (regexp_matches(t, '{_KEY}') AND length(trim(regexp_extract(t, '{_KEY}', 1))) < 50 AND length(trim(regexp_extract(t, '{_KEY}', 2))) < 200) OR (NOT regexp_matches(t, '{_KEY}') AND regexp_matches(t, '{_VALUE}') AND length(trim(regexp_extract(t, '{_VALUE}', 1))) < 50)", X.STRINGS))
def kv_pairs(spark, d):
    t = X.strings(spark, d).select("o_orderkey", T.strip(F.col("s")).alias("t"))
    one = F.col("t").rlike(_KEY)
    k = F.trim(F.when(one, F.regexp_extract("t", _KEY, 1)).otherwise(F.regexp_extract("t", _VALUE, 1)))
    v = F.trim(F.when(one, F.regexp_extract("t", _KEY, 2)).otherwise(F.regexp_extract("t", _VALUE, 2)))
    return t.where(one | F.col("t").rlike(_VALUE)).select("o_orderkey", k.alias("k"), v.alias("v")).where((F.length("k") < 50) & (F.length("v") < 200))


_IDS = ("2_patient_name", "1a_insured_id", "21_diagnosis_a", "24_service_lines", "33a_npi", "99_other", "4_insured_name", "12_sign")
_SECTIONS_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"starts_with(fid, '{p}')" for p in ps) + f" THEN '{n}'" for n, ps in T.SECTIONS) + " WHEN contains(label, 'diagnosis') THEN 'diagnosis' WHEN contains(label, 'service') AND contains(label, 'line') THEN 'service_lines' END"


@query("infer_section", f"SELECT o_orderkey, fid, {_SECTIONS_SQL} AS section FROM (SELECT o_orderkey, {X.pick_sql(_IDS, 'o_orderkey % 8')} AS fid, CASE WHEN o_custkey % 2 = 0 THEN 'diagnosis list' ELSE 'service line' END AS label FROM orders)")
def infer_section(spark, d):
    o = X.load(spark, d, "orders").select("o_orderkey", X.pick(_IDS, F.col("o_orderkey") % 8).alias("fid"), F.when(F.col("o_custkey") % 2 == 0, "diagnosis list").otherwise("service line").alias("label"))
    return o.select("o_orderkey", "fid", T.infer_section(F.col("fid"), F.col("label")).alias("section"))


@query("confidence_band", X.with_("SELECT doc_id, seq, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band, CASE WHEN confidence > 0.85 THEN 'high' WHEN confidence > 0.6 THEN 'medium' ELSE 'low' END AS export_band, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS ui_band FROM blocks", X.BLOCKS))
def confidence_band(spark, d):
    c = F.col("confidence")
    return X.blocks(spark, d).select("doc_id", "seq", T.confidence_band(c).alias("band"), F.when(c > 0.85, "high").when(c > 0.6, "medium").otherwise("low").alias("export_band"), T.confidence_band(c, 0.8, 0.5).alias("ui_band"))


@query("field_score", X.with_("SELECT doc_id, seq, least(1.0, greatest(0.0, 0.6 * confidence + 0.3 * (1.0 - confidence) + 0.1 * CASE WHEN type = 'form' THEN 1.0 ELSE 0.0 END))::DOUBLE AS score FROM (SELECT doc_id, seq, type, confidence::DOUBLE AS confidence FROM blocks)".replace("0.6 *", "0.6::DOUBLE *").replace("0.3 *", "0.3::DOUBLE *").replace("0.1 *", "0.1::DOUBLE *"), X.BLOCKS))
def field_score(spark, d):
    c = F.col("confidence")
    s = F.lit(0.6) * c + F.lit(0.3) * (F.lit(1.0) - c) + F.lit(0.1) * F.when(F.col("type") == "form", 1.0).otherwise(0.0)
    return X.blocks(spark, d).select("doc_id", "seq", F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)).alias("score"))


_ALL = "(" + ", ".join(f"'{s}'" for s in (*V.STATES, *V.TERRITORIES)) + ")"
_PLACE = f"nullif(concat_ws(' ', nullif(city, ''), CASE WHEN upper(trim(f_state)) IN {_ALL} THEN upper(trim(f_state)) END), '')"
_CODE = "CASE WHEN length(regexp_replace(f_zip, '[^0-9]', '', 'g')) IN (5, 9) THEN regexp_replace(f_zip, '[^0-9]', '', 'g') END"


@query("compose_address", X.with_(f"SELECT o_orderkey, CASE WHEN {_PLACE} IS NULL AND nullif(street, '') IS NOT NULL THEN concat_ws(' ', nullif(street, ''), {_CODE}) ELSE concat_ws(', ', nullif(street, ''), nullif(concat_ws(' ', {_PLACE}, {_CODE}), '')) END AS address FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_custkey || ' Main St' END AS street, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Town' END AS city FROM fields)", X.FIELDS))
def compose_address(spark, d):
    street = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat("o_custkey", F.lit(" Main St")))
    city = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("Town")
    return X.fields(spark, d).select("o_orderkey", T.compose_address(street, city, F.col("f_state"), F.col("f_zip"), (*V.STATES, *V.TERRITORIES)).alias("address"))


_MARKS = ("X", "", "checked", "none", "true", "0", "1", "no")


@query("compose_sex", f"""SELECT o_orderkey, CASE WHEN m NOT IN ('', 'none', 'null', '0') AND (contains(m, 'x') OR m IN ('checked', 'true', '1')) THEN 'M' WHEN f NOT IN ('', 'none', 'null', '0') AND (contains(f, 'x') OR f IN ('checked', 'true', '1')) THEN 'F' WHEN o_orderkey % 2 = 0 THEN 'F' ELSE '' END AS sex
FROM (SELECT o_orderkey, lower({X.pick_sql(_MARKS, 'o_orderkey % 8')}) AS m, lower({X.pick_sql(_MARKS, 'o_custkey % 8')}) AS f FROM orders)""")
def compose_sex(spark, d):
    checked = lambda v: ~v.isin("", "none", "null", "0") & (v.contains("x") | v.isin("checked", "true", "1"))
    o = X.load(spark, d, "orders").select("o_orderkey", F.lower(X.pick(_MARKS, F.col("o_orderkey") % 8)).alias("m"), F.lower(X.pick(_MARKS, F.col("o_custkey") % 8)).alias("f"), F.when(F.col("o_orderkey") % 2 == 0, " f").otherwise("").alias("raw"))
    fallback = F.when(F.col("raw").contains(" m") | (F.trim("raw") == "m"), "M").when(F.col("raw").contains(" f") | (F.trim("raw") == "f"), "F").otherwise("")
    return o.select("o_orderkey", F.when(checked(F.col("m")), "M").when(checked(F.col("f")), "F").otherwise(fallback).alias("sex"))
