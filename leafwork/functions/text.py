"""Text repair and classification as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sub(text: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(new))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return sub(text, r"^\s+|\s+$", "")


def fix_hyphenation(text: Column) -> Column:
    """Join words broken by a hyphen, over a line end first and then within a line."""
    return sub(sub(text, r"([a-zA-Z])-\s*\n\s*([a-z])", "$1$2"), r"([a-zA-Z])-\s+([a-z])", "$1$2")


def clean_text(text: Column) -> Column:
    """Single spaces, at most one blank line, | as l and 0 as O: the strict rule, which harms numbers."""
    return F.translate(strip(sub(sub(text, " +", " "), r"\n\n+", "\n\n")), "|0", "lO")


def normalize_whitespace(text: Column) -> Column:
    return sub(sub(sub(text, "\t", " "), " +", " "), "\r\n?", "\n")


def ocr_repair(text: Column) -> Column:
    """Repairs after recognition, in a fixed order."""
    t = F.translate(text, "|", "l")
    for pattern, new in (
        (r"\s+([.,;:!?])", "$1"), (r"([.,;:!?])\s*([A-Z])", "$1 $2"), (r"([A-Z])\.([a-z])", "$1. $2"), (r"(\d)O(\d)", "$1\\0$2"), (r"(\d{1,2})O\b", "$1\\0"),
        (r"\b(\d{1,2})\s*\)\s*,\s*(\d{4})\b", "$1, $2"),
    ):
        t = sub(t, pattern, new)
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != "")
    return strip(sub(F.replace(F.array_join(lines, "\n"), F.lit("-\n"), F.lit("")), " +", " "))


#: Pre-printed labels (fixed values), removed in this order with nothing in their place.
BUSINESS_LABELS = (
    r"P?ATIENT'?S?\s+NAME\s*\(La", r"P?ATIENT'?S?\s+NAME\s*", r"P?ATIENT'?S?\s+BIRTH\s*", r"P?ATIENT'?S?\s+ADDRESS\s*", r"P?ATIENT'?S?\s+PHONE\s*", r"P?ATIENT'?S?\s+ACCOUNT\s*",
    r"I?NSURED'?S?\s*I\.?D\.?\s*N\w*\s*", r"I?NSURED'?S?\s+NAME\s*\(La", r"I?NSURED'?S?\s+NAME\s*", r"I?NSURED'?S?\s+ADDRESS\s*", r"I?NSURED'?S?\s+DATE\s+OF\s+BIRT\w*\s*", r"I?NSURED'?S?\s+POLICY\s*",
    r"INSURANCE\s+PLAN\s+NAME\s*", r"SIGNATURE\s+OF\s+PHYSICIAN[^,]*", r"SIGNATURE\s+OF\s*", r"BILLING\s+PROVIDER[^,]*", r"SERVICE\s+FACILITY[^,]*", r"MM\s+DD\s+Y+", r"MM\s+DD\s+", r"^MM\s+DD\s*",
)
#: Labels (fixed values) that a zone's text loses, each for a space.
ZONE_LABELS = (
    r"^\s*\d+\s*[a-z]?\s*\.?\s*", r"P?ATIENT'?S?\s*(NAME|BIRTH|ADDRESS|SEX|PHONE|RELATIONSHIP)", r"I?NSURED'?S?\s*(NAME|I\.?D\.?\s*N|ADDRESS|DATE|POLICY|GROUP)", r"OTHER\s+INSURED'?S?\s*(NAME|POLICY)",
    r"INSURANCE\s+PLAN\s+NAME", r"EMPLOYER'?S?\s*NAME", r"REFERRING\s+PROVIDER", r"SIGNATURE\s+OF", r"BILLING\s+PROVIDER", r"SERVICE\s+FACILITY", r"DATE\s+OF\s+CURRENT", r"DIAGNOSIS\s+OR\s+NATURE",
    r"\(?\s*MM\s+DD\s+Y+\s*\)?", r"MM\s*DD\s*YY", r"\(Last.*?(First|Name)\)", r"\(No\.,?\s*S.*?\)", r"\(Include\s+Area\s+Code\)", r"OR\s+PROGR\s*AM\s+NAME", r"\(For\s+Program.*?\)",
    r"CITY(?:\s|$)", r"STATE(?:\s|$)", r"ZIP\s*CODE", r"TELEPHONE", r"SEX\s*[MF]?",
)
_PARENTHESES = (r"\(Last[^)]*\)", r"\(No\.[^)]*\)", r"\(Include[^)]*\)")
_EDGE = r"[\s()\[\].,\-:]+"


def _trimmed(text: Column) -> Column:
    return sub(sub(strip(sub(text, r"\s+", " ")), "^" + _EDGE, ""), _EDGE + "$", "")


def strip_labels_business(text: Column) -> Column:
    t = sub(text, r"(?i)^\d+\s*[a-z]?\.\s*", "")
    bare = reduce(lambda x, p: sub(x, p, ""), (*("(?i)" + p for p in BUSINESS_LABELS), *_PARENTHESES), t)
    return _trimmed(F.when(t.rlike("[A-Za-z]{2}"), bare).otherwise(t))  # every label has two letters in a row


def strip_labels_zone(text: Column) -> Column:
    t = sub(text, "(?i)" + ZONE_LABELS[0], " ")
    bare = reduce(lambda x, p: sub(x, "(?i)" + p, " "), ZONE_LABELS[1:], t)
    return _trimmed(F.when(t.rlike("[A-Za-z]{2}"), bare).otherwise(t))  # every label but the first has two letters in a row


def strip_labels_sql(expr: str, business: bool) -> str:
    """The same in DuckDB."""
    t = expr
    if business:
        t = rf"regexp_replace({t}, '^\d+\s*[a-z]?\.\s*', '', 'gi')"
    for p in BUSINESS_LABELS if business else ZONE_LABELS:
        t = f"regexp_replace({t}, '{p.replace(chr(39), chr(39) * 2)}', '{'' if business else ' '}', 'gi')"
    for p in _PARENTHESES if business else ():
        t = f"regexp_replace({t}, '{p}', '', 'g')"
    t = rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"
    return f"regexp_replace(regexp_replace({t}, '^{_EDGE}', ''), '{_EDGE}$', '')"


#: Ordered substrings (fixed values) that decide a field's type by its label.
GUESSES = (
    ("npi", ("npi",)), ("ndc", ("ndc", "drug")), ("icd", ("icd", "diagnosis")), ("hcpcs", ("hcpcs", "procedure")), ("date", ("date", "dob")), ("phone", ("phone", "contact", "tel")),
    ("member_id", ("member", "id")), ("numeric", ("zip", "postal")), ("ssn", ("ssn", "social")), ("money", ("amount", "paid", "charge")),
)


def guess_field_type(label: Column) -> Column:
    low, out = F.lower(label), F.lit(None).cast("string")
    for name, parts in reversed(GUESSES):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(p) for p in parts]), F.lit(name)).otherwise(out)
    return out


def guess_field_type_sql(label: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({label}), '{p}')" for p in parts) + f" THEN '{n}'" for n, parts in GUESSES) + " END"


def confidence_band(value: Column, high: float = 0.9, medium: float = 0.7) -> Column:
    return F.when(value >= high, "high").when(value >= medium, "medium").otherwise("low")


#: Prefixes of field ids (fixed values) by section of the form.
SECTIONS = (
    ("patient", ("2_", "3_", "5_", "12_", "15_", "16_")), ("insured", ("1a_", "4_", "7_", "9_", "11_", "13_")), ("provider", ("25_", "26_", "27_", "28_", "29_", "32_", "33_")), ("diagnosis", ("21_",)),
    ("service_lines", ("24_",)),
)


def infer_section(field_id: Column, label: Column) -> Column:
    i, low = F.lower(field_id), F.lower(label)
    out = F.when(low.contains("diagnosis"), "diagnosis").when(low.contains("service") & low.contains("line"), "service_lines")
    for name, prefixes in reversed(SECTIONS):
        out = F.when(reduce(lambda a, b: a | b, [i.startswith(p) for p in prefixes]), name).otherwise(out)
    return out


def compose_address(address: Column, city: Column, state: Column, zip_code: Column, states: tuple) -> Column:
    """Address, "city state zip". A zip code without anything before it stands alone."""
    st, digits = F.upper(strip(state)), sub(zip_code, "[^0-9]", "")
    some = lambda c: F.nullif(c, F.lit(""))
    place = some(F.concat_ws(" ", some(city), F.when(st.isin(*states), st)))
    code = F.when(F.length(digits).isin(5, 9), digits)
    return F.when(place.isNull() & some(address).isNotNull(), F.concat_ws(" ", some(address), code)).otherwise(F.concat_ws(", ", some(address), some(F.concat_ws(" ", place, code))))
