"""Text rules as column expressions: keyword classes, dates, names and confidence."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from moundwork.functions import vocabulary as v

UNKNOWN = "unknown"
NAME = r"^[A-Z][a-z]+ [A-Z][a-z]+$"
JOINED_NAME = r"^[A-Z][a-z]+[-.][A-Z][a-z]+$"

# Date patterns tried in order, then the formats of whole-string dates.
DATE_PATTERNS = (
    r"(\d{1,2}/\d{1,2}/\d{4})",
    r"(\d{1,2}-\d{1,2}-\d{4})",
    r"(\w+ \d{1,2}, \d{4})",
    r"(\d{1,2}/\d{1,2})",
    r"(\d{4}-\d{2}-\d{2})",
)
ASSUMED_YEAR = "2024"
DATE_FORMATS = (
    "M/d/yyyy", "yyyy-M-d", "M/d/yy", "MMMM d, yyyy", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'",
    "M-d-yyyy", "d/M/yyyy",
)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def needed_terms(terms: Iterable[str]) -> list[str]:
    """Drop terms that contain another term of the list: the shorter one matches whenever they do."""
    terms = list(dict.fromkeys(terms))
    return [t for t in terms if not any(o != t and o in t for o in terms)]


def has_any(low: Column, terms: Iterable[str]) -> Column:
    hit = F.lit(False)
    for term in needed_terms(terms):
        hit = hit | low.contains(term)
    return hit


def first_category(low: Column, table: Mapping[str, Sequence[str]], default: str = UNKNOWN) -> Column:
    """First category of ``table``, in its order, with a keyword inside the lower-cased text."""
    out = None
    for category, terms in table.items():
        hit = has_any(low, terms)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(default)


def injury_location(low: Column, table: Mapping[str, Sequence[str]] = v.LOCATIONS) -> Column:
    return first_category(low, table)


def injury_type(low: Column, table: Mapping[str, Sequence[str]] = v.TYPES) -> Column:
    return first_category(low, table)


def severity(low: Column, table: Mapping[str, Sequence[str]] = v.SEVERITIES) -> Column:
    return first_category(low, table)


def medical_term_location(low: Column) -> Column:
    return first_category_of_terms(low, v.MEDICAL_TERMS)


def first_category_of_terms(low: Column, terms: Mapping[str, str]) -> Column:
    out = None
    for term, location in terms.items():
        hit = low.contains(term)
        out = F.when(hit, location) if out is None else out.when(hit, location)
    return out.otherwise(UNKNOWN)


def context_location(low: Column) -> Column:
    return first_category(low, v.CONTEXT_LOCATIONS)


def pattern_type(low: Column) -> Column:
    return first_category(low, v.PATTERN_TYPES)


def clamp01(score: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)


def points(condition: Column, value: float) -> Column:
    return F.when(condition, value).otherwise(0.0)


def parse_confidence(size: Column, medical: Column, base: Column, location: Column, kind: Column, level: Column) -> Column:
    score = (
        base
        + points((location != UNKNOWN) & (kind != UNKNOWN), 0.1)
        + points(level != UNKNOWN, 0.05)
        + points(size > 50, 0.05)
        + points(medical, 0.1)
        - points(size < 10, 0.1)
    )
    return clamp01(score)


def record_confidence(info: Column, status: Column, kind: Column, location: Column) -> Column:
    """Confidence of a table row; rows below 0.3 are not kept by the readers."""
    score = (
        points(strip(info) != "", 0.3)
        + points(strip(status) != "", 0.2)
        + points(kind != UNKNOWN, 0.2)
        + points(location != UNKNOWN, 0.2)
        + points(has_any(F.lower(status), v.RECORD_SEVERITY_WORDS), 0.1)
        - points(F.length(info) < 10, 0.1)
    )
    return clamp01(score)


def extract_injury_date(text: Column, reference: Column) -> Column:
    """Date inside a report.

    Each pattern is tried in order and only month/day/year values parse (a month/day gets the
    assumed year); otherwise a relative word shifts ``reference``, which is also the default.
    """
    tries = []
    for pattern in DATE_PATTERNS:
        found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
        full = F.when(F.size(F.split(found, "/")) == 2, F.concat(found, F.lit("/" + ASSUMED_YEAR))).otherwise(found)
        valid = F.when(full.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), full)
        tries.append(F.to_date(F.try_to_timestamp(valid, F.lit("M/d/yyyy"))))
    low = F.lower(text)
    shift = F.lit(0)
    for word, days in reversed(v.RELATIVE_DAYS.items()):
        shift = F.when(low.contains(word), days).otherwise(shift)
    return F.coalesce(*tries, F.date_add(reference, shift))


def parse_date_multi(value: Column, default: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that reads the whole string; placeholders and failures give ``default``."""
    missing = value.isNull() | F.lower(value).isin(*v.UNKNOWN_DATES)
    tries = []
    for f in formats:
        day = F.to_date(F.try_to_timestamp(value, F.lit(f)))
        if f.endswith("/yy"):  # two-digit years from 69 on belong to the last century
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        tries.append(day)
    return F.when(missing, default).otherwise(F.coalesce(*tries, default))


def il_injury_type(description: Column) -> Column:
    return first_category(F.lower(description), v.LIST_INJURY_TYPES, "Unspecified Injury")


def il_stint_type(description: Column) -> Column:
    return first_category(F.lower(description), v.LIST_STINTS, "10-day IL")


def stint_type_by_duration(days: Column) -> Column:
    return F.when(days <= 15, "10-day IL").when(days <= 60, "15-day IL").otherwise("60-day IL")


def looks_like_name(col: Column) -> Column:
    return F.length(col).between(3, 50) & (col.rlike(NAME) | col.rlike(JOINED_NAME))


def surrogate_id(name: Column, team: Column | None = None) -> Column:
    key = name if team is None else F.concat_ws("_", name, team)
    return F.concat(F.lit("temp_"), F.substring(F.md5(key), 1, 8))


def normalize_text(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), "[^a-z0-9 ]", " ")


def is_arm_injury(low: Column) -> Column:
    return has_any(low, v.ARM_WORDS) & ~has_any(low, v.NOT_ARM_WORDS)
