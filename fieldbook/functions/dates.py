"""Strict dates, zoned times, countdowns and labels. The current day is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"


def strict_date(text: Column) -> Column:
    """Date of ``YYYY-MM-DD``; null for any other form and for days that don't exist."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def zoned_instant(text: Column) -> Column:
    """Instant of a complete date-time with offset; null otherwise."""
    return F.when(text.rlike(ZONED), F.try_to_timestamp(text))


def partial_date(text: Column) -> tuple[Column, Column]:
    """``(year, month)`` of ``YYYY``, ``YYYY-MM`` or a longer date."""
    y, m = F.regexp_extract(text, r"^(\d{4})", 1), F.regexp_extract(text, r"^\d{4}-(\d{2})", 1)
    return F.when(y != "", y).cast("int"), F.when(m != "", m).cast("int")


def countdown_days(date: Column, as_of: str) -> Column:
    return F.datediff(date, F.lit(as_of).cast("date"))


def countdown_label(date: Column, as_of: str) -> Column:
    d = countdown_days(date, as_of)
    return F.when(date.isNull(), "unknown").when(d > 0, F.concat(F.lit("D-"), d.cast("string"))).when(d == 0, "today").otherwise("past")


def date_range_label(start: Column, end: Column) -> Column:
    """One day, or both ends where they differ."""
    one = F.date_format(start, "yyyy-MM-dd")
    return F.when(end.isNull() | (end == start), one).otherwise(F.concat(one, F.lit(" ~ "), F.date_format(end, "yyyy-MM-dd")))


def weekday(date: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(date) - 1


def local_date(instant: Column, zone: Column, known_zones: list[str]) -> Column:
    """Local day of an instant in a zone of the row; null where the zone is not one of ``known_zones``."""
    ok = F.when(zone.isin(known_zones), zone)
    return F.when(ok.isNotNull(), F.to_date(F.from_utc_timestamp(instant, F.coalesce(ok, F.lit("UTC")))))


def edition_completed(start: Column, end: Column, zone: Column, now: Column, known_zones: list[str]) -> Column:
    """The last local day is over. An unknown zone or date keeps the row (false)."""
    today = local_date(now, zone, known_zones)
    return F.coalesce(today > F.coalesce(end, start), F.lit(False))


def cutoff_day_offset(start_local: Column, cutoff_local: Column) -> Column:
    """``+n`` days between the local days of start and cutoff; empty on the same day."""
    d = F.datediff(F.to_date(cutoff_local), F.to_date(start_local))
    return F.when(d > 0, F.concat(F.lit("+"), d.cast("string"))).otherwise("")


def days_in_month(date: Column) -> Column:
    return F.dayofmonth(F.last_day(date))
