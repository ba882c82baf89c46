"""Three families of field validators; their verdicts differ on purpose. Each rule yields passed, normalized and reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwork.functions.text import strip, sub

#: How a value is cleaned, and the pattern it must match (fixed values).
FORMATS = {
    "ndc": ("squash", r"^\d{4,5}-?\d{3,4}-?\d{1,2}$"),
    "icd": ("squash", r"^[A-TV-Z][0-9][0-9A-Z](\.[0-9A-Z]{1,4})?$"),
    "hcpcs": ("squash", r"^[A-V][0-9]{4}$"),
    "member_id": ("squash", r"^[A-Z0-9]{6,15}$"),
    "date": ("strip", r"^(0?[1-9]|1[0-2])[\-/](0?[1-9]|[12][0-9]|3[01])[\-/](\d{2}|\d{4})$"),
    "phone": ("strip", r"^\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}$"),
    "ssn": ("strip", r"^\d{3}-?\d{2}-?\d{4}$"),
    "zip": ("strip", r"^\d{5}(-\d{4})?$"),
    "tax_id": ("strip", r"^\d{2}-?\d{7}$"),
    "money": ("unspaced", r"^[$]?\d{1,6}(,\d{3})*(\.\d{1,2})?$"),
}
STATES = tuple("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split())
TERRITORIES = ("PR", "VI", "GU", "AS", "MP")
FAMILY_1 = ("npi", *FORMATS, "numeric")
FAMILY_2 = ("date", "phone", "npi", "icd", "cpt", "money", "tax_id", "state", "zip")
#: Patterns of the third family (fixed values).
PATTERNS_3 = {"date": r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})$", "phone": r"^[\d\(\)\-\s]{10,14}$", "npi": r"^\d{10}$", "icd": r"^[A-Z]\d{2}\.?\d{0,4}$", "cpt": r"^\d{5}$", "zip": r"^\d{5}(-\d{4})?$"}


def _verdict(ok: Column, normalized: Column, reason: Column) -> Column:
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(ok.alias("passed"), F.when(ok, normalized).alias("normalized"), F.when(~ok, reason).alias("reason"))


def digits_of(value: Column) -> Column:
    return sub(value, "[^0-9]", "")


def luhn_sum(digits: Column, double_first: bool) -> Column:
    """Sum with every second digit doubled; from the left, starting with the first or the second one."""
    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == (1 if double_first else 0), twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add)


def first_family(kind: str, value: Column) -> Column:
    v = F.coalesce(value, F.lit(""))
    if kind == "npi":
        d = digits_of(v)
        right = F.length(d) == 10
        return _verdict(right & (F.when(right, luhn_sum(d, True)) % 10 == 0), d, F.when(right, "checksum").otherwise("length"))
    if kind == "numeric":
        d = digits_of(v)
        return _verdict(F.length(d).between(1, 20), d, F.lit("length"))
    if kind not in FORMATS:
        return _verdict(F.lit(False), v, F.lit("unknown_validator"))
    how, pattern = FORMATS[kind]
    clean = F.upper(F.replace(v, F.lit(" "), F.lit(""))) if how == "squash" else strip(v) if how == "strip" else F.replace(v, F.lit(" "), F.lit(""))
    d = digits_of(clean)
    part = lambda i, n: F.substring(d, i, n)
    if kind == "date":
        month, day, year = (F.regexp_extract(clean, pattern, i) for i in (1, 2, 3))
        normal = F.concat(F.lpad(month, 2, "0"), F.lit("/"), F.lpad(day, 2, "0"), F.lit("/"), F.when(F.length(year) == 2, F.concat(F.when(year < "50", "20").otherwise("19"), year)).otherwise(year))
    elif kind == "phone":
        normal = F.concat(F.lit("("), part(1, 3), F.lit(") "), part(4, 3), F.lit("-"), part(7, 4))
    elif kind == "ssn":
        normal = F.concat_ws("-", part(1, 3), part(4, 2), part(6, 4))
    elif kind == "tax_id":
        normal = F.concat_ws("-", part(1, 2), part(3, 7))
    elif kind == "money":
        normal = F.when(clean.startswith("$"), clean).otherwise(F.concat(F.lit("$"), clean))
    else:
        normal = clean
    return _verdict(clean.rlike(pattern), normal, F.when(v == "", "empty").otherwise("format"))


def _luhn_sql(digits: str) -> str:
    d = f"substr({digits}, i, 1)::INT"
    return f"list_sum([CASE WHEN i % 2 = 1 THEN {d} * 2 - CASE WHEN {d} > 4 THEN 9 ELSE 0 END ELSE {d} END for i in range(1, length({digits}) + 1)])"


def first_family_sql(kind: str, v: str) -> str:
    """passed, normalized, reason in DuckDB, for a column v."""
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    if kind == "npi":
        total = _luhn_sql(d)
        ok, normal, reason = f"(length({d}) = 10 AND {total} % 10 = 0)", d, f"CASE WHEN length({d}) = 10 THEN 'checksum' ELSE 'length' END"
    elif kind == "numeric":
        ok, normal, reason = f"(length({d}) BETWEEN 1 AND 20)", d, "'length'"
    else:
        how, pattern = FORMATS[kind]
        c = {"squash": f"upper(replace({v}, ' ', ''))", "strip": f"trim({v})", "unspaced": f"replace({v}, ' ', '')"}[how]
        d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
        year = f"regexp_extract({c}, '{pattern}', 3)"
        normal = {
            "date": f"lpad(regexp_extract({c}, '{pattern}', 1), 2, '0') || '/' || lpad(regexp_extract({c}, '{pattern}', 2), 2, '0') || '/' || CASE WHEN length({year}) = 2 THEN CASE WHEN {year} < '50' THEN '20' ELSE '19' END || {year} ELSE {year} END",
            "phone": f"'(' || substr({d}, 1, 3) || ') ' || substr({d}, 4, 3) || '-' || substr({d}, 7, 4)",
            "ssn": f"substr({d}, 1, 3) || '-' || substr({d}, 4, 2) || '-' || substr({d}, 6, 4)",
            "tax_id": f"substr({d}, 1, 2) || '-' || substr({d}, 3, 7)",
            "money": f"CASE WHEN {c}[1] = '$' THEN {c} ELSE '$' || {c} END",
        }.get(kind, c)
        ok, reason = f"regexp_matches({c}, '{pattern}')", f"CASE WHEN {v} = '' THEN 'empty' ELSE 'format' END"
    return f"{ok} AS passed, CASE WHEN {ok} THEN {normal} END AS normalized, CASE WHEN NOT {ok} THEN {reason} END AS reason"


def second_family(kind: str, value: Column) -> Column:
    """passed and normalized; an empty value passes, a failed one is returned as it came."""
    v = F.coalesce(value, F.lit(""))
    d, up = digits_of(v), F.upper(strip(v))
    part = lambda i, n: F.substring(d, i, n)
    phone = lambda i: F.concat(F.lit("("), part(i, 3), F.lit(") "), part(i + 3, 3), F.lit("-"), part(i + 6, 4))
    if kind == "date":
        one, two = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})", r"(\d{4})[/\-](\d{1,2})[/\-](\d{1,2})"
        g = lambda p, i: F.regexp_extract(v, p, i)
        year = g(one, 3)
        first = F.concat_ws("/", F.lpad(g(one, 1), 2, "0"), F.lpad(g(one, 2), 2, "0"), F.when(F.length(year) == 2, F.concat(F.when(year > "50", "19").otherwise("20"), year)).otherwise(year))
        second = F.concat_ws("/", F.lpad(g(two, 2), 2, "0"), F.lpad(g(two, 3), 2, "0"), g(two, 1))
        ok, normal = v.rlike(one) | v.rlike(two), F.when(v.rlike(one), first).otherwise(second)
    elif kind == "phone":
        long = (F.length(d) == 11) & d.startswith("1")
        ok, normal = (F.length(d) == 10) | long, F.when(long, phone(2)).otherwise(phone(1))
    elif kind == "npi":
        ok, normal = F.when(F.length(d) == 10, luhn_sum(F.concat(F.lit("80840"), d), True) % 10 == 0).otherwise(False), d
    elif kind == "icd":
        ok, normal = up.rlike(PATTERNS_3["icd"]), up
    elif kind == "cpt":
        ok, normal = F.length(d) == 5, d
    elif kind == "money":
        amount = sub(v, r"[^\d.]", "")
        ok, normal = amount.rlike(r"^(\d+\.?\d*|\.\d+)$"), F.format_string("$%.2f", amount.try_cast("double"))
    elif kind == "tax_id":
        ok, normal = F.length(d) == 9, F.concat_ws("-", part(1, 2), part(3, 7))
    elif kind == "state":
        ok, normal = up.isin(*STATES), up
    else:
        ok, normal = F.length(d).isin(5, 9), F.when(F.length(d) == 5, d).otherwise(F.concat_ws("-", part(1, 5), part(6, 4)))
    return F.struct(((v == "") | ok).alias("passed"), F.when(v == "", "").when(ok, normal).otherwise(v).alias("normalized"))


def second_family_sql(kind: str, v: str) -> str:
    d, up = f"regexp_replace({v}, '[^0-9]', '', 'g')", f"upper(trim({v}))"
    phone = lambda i: f"'(' || substr({d}, {i}, 3) || ') ' || substr({d}, {i + 3}, 3) || '-' || substr({d}, {i + 6}, 4)"
    if kind == "date":
        one, two = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})", r"(\d{4})[/\-](\d{1,2})[/\-](\d{1,2})"
        g = lambda p, i: f"regexp_extract({v}, '{p}', {i})"
        y = g(one, 3)
        ok = f"(regexp_matches({v}, '{one}') OR regexp_matches({v}, '{two}'))"
        normal = f"CASE WHEN regexp_matches({v}, '{one}') THEN lpad({g(one, 1)}, 2, '0') || '/' || lpad({g(one, 2)}, 2, '0') || '/' || CASE WHEN length({y}) = 2 THEN CASE WHEN {y} > '50' THEN '19' ELSE '20' END || {y} ELSE {y} END ELSE lpad({g(two, 2)}, 2, '0') || '/' || lpad({g(two, 3)}, 2, '0') || '/' || {g(two, 1)} END"
    elif kind == "phone":
        long = f"(length({d}) = 11 AND {d}[1] = '1')"
        ok, normal = f"(length({d}) = 10 OR {long})", f"CASE WHEN {long} THEN {phone(2)} ELSE {phone(1)} END"
    elif kind == "npi":
        f = f"('80840' || {d})"
        total = _luhn_sql(f)
        ok, normal = f"(length({d}) = 10 AND {total} % 10 = 0)", d
    elif kind == "icd":
        ok, normal = f"regexp_matches({up}, '{PATTERNS_3['icd']}')", up
    elif kind == "cpt":
        ok, normal = f"(length({d}) = 5)", d
    elif kind == "money":
        amount = rf"regexp_replace({v}, '[^\d.]', '', 'g')"
        ok, normal = rf"regexp_matches({amount}, '^(\d+\.?\d*|\.\d+)$')", f"printf('$%.2f', try_cast({amount} AS DOUBLE))"
    elif kind == "tax_id":
        ok, normal = f"(length({d}) = 9)", f"substr({d}, 1, 2) || '-' || substr({d}, 3, 7)"
    elif kind == "state":
        ok, normal = f"({up} IN ({', '.join(repr(s) for s in STATES)}))", up
    else:
        ok, normal = f"(length({d}) IN (5, 9))", f"CASE WHEN length({d}) = 5 THEN {d} ELSE substr({d}, 1, 5) || '-' || substr({d}, 6, 4) END"
    return f"({v} = '' OR {ok}) AS passed, CASE WHEN {v} = '' THEN '' WHEN {ok} THEN {normal} ELSE {v} END AS normalized"


def third_family(kind: str, value: Column) -> Column:
    """Whether the value passes; empty values and unknown kinds do."""
    if kind not in PATTERNS_3:
        return F.lit(True)
    v = F.coalesce(value, F.lit(""))
    return (v == "") | F.upper(strip(v)).rlike(PATTERNS_3[kind])
