"""Effective-date predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# None stands for today and for the present.
Date = dt.date | Column | None
Instant = dt.datetime | Column | None


def as_date(value: Date) -> Column:
    if value is None:
        return F.current_date()
    return value if isinstance(value, Column) else F.lit(value)


def as_instant(value: Instant) -> Column:
    """A wall-clock time, without a time zone so that sessions agree on it."""
    if value is None:
        return F.localtimestamp()
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def effective(
    start: Column,
    end: Column,
    as_of: Date,
    now: Instant = None,
    null_start: str = "drop",
    null_end: str = "drop",
) -> Column:
    """True where ``as_of`` lies between start and end, both included.

    A missing bound drops the row unless it is declared 'open'. With ``now``, a
    missing bound stands for that time of day instead: midnight of ``as_of`` is
    not before it, so a missing start drops the row (but at midnight) and a
    missing end keeps it. The bounds are compared bare, which lets
    the scan skip row groups.
    """
    day = as_date(as_of)
    keep_start = keep_end = F.lit(False)
    if now is not None:
        midnight, instant = day.cast("timestamp_ntz"), as_instant(now)
        keep_start, keep_end = midnight >= instant, midnight <= instant
    if null_start == "open":
        keep_start = F.lit(True)
    if null_end == "open":
        keep_end = F.lit(True)
    started = (start <= day) | (start.isNull() & keep_start)
    running = (end >= day) | (end.isNull() & keep_end)
    return started & running
