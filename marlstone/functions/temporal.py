"""UUIDv7 time bounds and named ranges as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _stamp(ms: Column) -> Column:
    """The low 48 bits of a time in milliseconds, not below 0, as 8-4 hexadecimal digits."""
    code = F.right(F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.floor(ms)).cast("long"))), 16, "0"), F.lit(12))
    return F.concat(F.substring(code, 1, 8), F.lit("-"), F.substring(code, 9, 4))


def v7_floor(ms: Column) -> Column:
    """The smallest UUIDv7 of a millisecond."""
    return F.concat(_stamp(ms), F.lit("-7000-8000-000000000000"))


def v7_ceiling(ms: Column) -> Column:
    """The largest UUIDv7 of a millisecond."""
    return F.concat(_stamp(ms), F.lit("-7fff-bfff-ffffffffffff"))


def range_bounds(start: Column | None, end: Column | None) -> tuple[Column, Column]:
    """(floor, ceiling) of timestamps; by default from 1970 to a day after now."""
    low = F.lit(0) if start is None else F.coalesce(F.unix_millis(start), F.lit(0))
    high = F.unix_millis(F.current_timestamp() + F.expr("INTERVAL 1 DAY")) if end is None else F.unix_millis(end)
    return v7_floor(low), v7_ceiling(high)


RANGES = ("last_minute", "last_hour", "today", "this_week", "this_month", "this_quarter", "this_year")


def named_range(name: str, now: Column) -> Column:
    """Start of a named range, in the session's time zone; weeks begin on Sunday."""
    day = F.date_trunc("DAY", now)
    starts = {
        "last_minute": now - F.expr("INTERVAL 1 MINUTE"),
        "last_hour": now - F.expr("INTERVAL 1 HOUR"),
        "today": day,
        "this_week": F.date_sub(day, F.dayofweek(now) - 1).cast("timestamp"),
        "this_month": F.date_trunc("MONTH", now),
        "this_quarter": F.date_trunc("QUARTER", now),
        "this_year": F.date_trunc("YEAR", now),
    }
    return starts[name]
