"""Date expressions (month grain, day counts, calendar attributes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(c: Column | str) -> Column:
    """Timestamps (with or without zone) to DATE; dates pass through."""
    return _col(c).cast("date")


def month_start(c: Column | str) -> Column:
    """First day of the month as a DATE (``trunc`` keeps the date type)."""
    return F.trunc(as_date(c), "month")


def days_between(start: Column | str, end: Column | str) -> Column:
    """Number of day boundaries crossed from ``start`` to ``end`` (BIGINT).

    Both sides are reduced to dates first, so 23:00 -> 01:00 the next day
    counts 1 day, as a calendar day count should.
    """
    return F.date_diff(as_date(end), as_date(start)).cast("long")


def year_of(c: Column | str) -> Column:
    return F.year(_col(c)).cast("long")


def month_of(c: Column | str) -> Column:
    return F.month(_col(c)).cast("long")


def quarter_of(c: Column | str) -> Column:
    return F.quarter(_col(c)).cast("long")


def month_abbrev(c: Column | str) -> Column:
    """Three-letter English month name ('Jan')."""
    return F.date_format(_col(c), "MMM")


def day_abbrev(c: Column | str) -> Column:
    """Three-letter English day name ('Sun')."""
    return F.date_format(_col(c), "EEE")


def day_of_week(c: Column | str, week_start: str = "sunday") -> Column:
    """Zero-based day of week: Sunday=0 (``week_start='sunday'``) or Monday=0."""
    if week_start == "sunday":
        return (F.dayofweek(_col(c)) - 1).cast("long")
    if week_start == "monday":
        return F.weekday(_col(c)).cast("long")
    raise ValueError(f"week_start must be 'sunday' or 'monday', not {week_start!r}")
