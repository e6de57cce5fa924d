"""Dates and times as Column expressions; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: patterns tried in this order after ISO forms, and how their digits read.
PATTERNS = (
    (r"(\d{8}T\d{6})", "yyyyMMdd'T'HHmmss"),
    (r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"(\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2})", "yyyy:MM:dd HH:mm:ss"),
    (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"),
    (r"(?<!\d)((?:19|20)\d{6})(?!\d)", "yyyyMMdd"),
)
ISO = r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?\s*$"


def parse_datetime(text: Column) -> Column:
    """The first reading that succeeds; times without a zone are UTC; null if none does."""
    iso = F.when(text.rlike(ISO), F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", "+00:00")))
    basic = F.when(text.rlike(r"^\s*\d{8}\s*$"), F.try_to_timestamp(F.trim(text), F.lit("yyyyMMdd")))
    tried = [F.try_to_timestamp(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit(f)) for p, f in PATTERNS]
    return F.coalesce(iso, basic, *tried)


def day_gap(a: Column, b: Column) -> Column:
    """Days between two dates' places in the year, around its end the shorter way (of 365)."""
    days = F.abs(F.dayofyear(a) - F.dayofyear(b))
    return F.least(days, 365 - days)


def iso(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssXXX")


def whole_seconds(millis: Column) -> Column:
    return F.floor(millis / 1000)
