"""Dates in the spellings that award and employment records use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that are tried in order.
FORMATS = ("yyyy-M-d", "M/d/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "M-d-yyyy")
LONG_FORMATS = ("MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy")


def parse(x: Column | str, formats: tuple[str, ...] = FORMATS) -> Column:
    """The first spelling that fits, else null."""
    text = F.trim(F.col(x) if isinstance(x, str) else x)
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats))


def parse_long(x: Column | str) -> Column:
    """`December 1st, 2025` and the like."""
    text = F.col(x) if isinstance(x, str) else x
    plain = F.regexp_replace(F.regexp_replace(text, r"(?i)(\d)(st|nd|rd|th)\b", "$1"), r"[,\s]+", " ")
    return parse(plain, LONG_FORMATS)


def from_parts(year: Column, month: Column, day: Column) -> Column:
    """A date from numbers; an absent month or day is 1, nonsense is null."""
    part = lambda c: F.coalesce(F.expr("try_cast(NULL AS INT)"), c.try_cast("int"))
    spelled = F.concat_ws("-", part(year), F.coalesce(part(month), F.lit(1)), F.coalesce(part(day), F.lit(1)))
    return F.when(part(year).isNotNull(), F.to_date(F.try_to_timestamp(spelled, F.lit("yyyy-M-d"))))


def from_epoch(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def freshness(updated: Column, as_of: str) -> Column:
    days = F.datediff(F.to_date(F.lit(as_of)), updated)
    return F.when(days < 30, "fresh").when(days < 365, "aging").otherwise("stale")
