"""Run-date handling: parse ``YYYY-MM-DD`` / ``today`` / bad input, day windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _as_col(d) -> Column:
    if d is None:
        return F.lit(None).cast("string")
    return F.lit(d) if isinstance(d, str) else d


def parse_run_date(d) -> Column:
    """Target date: a valid ``yyyy-MM-dd`` string, else today (UTC).

    ``today``, NULL and malformed strings all fall back to ``current_date()``.
    """
    return F.coalesce(F.try_to_date(_as_col(d), "yyyy-MM-dd"), F.current_date())


def file_date(d) -> Column:
    """``YYYYMMDD`` name part of an output for a run date."""
    return F.date_format(parse_run_date(d), "yyyyMMdd")


def feed_day(d) -> Column:
    """The submission day the feed is queried for: target date minus one."""
    return F.date_sub(parse_run_date(d), 1)


def in_day(ts, day: Column) -> Column:
    """Half-open window ``[day 00:00, day+1 00:00)`` on a timestamp column."""
    start = day.cast("timestamp_ntz")
    end = F.date_add(day, 1).cast("timestamp_ntz")
    t = _c(ts).cast("timestamp_ntz")
    return (t >= start) & (t < end)


def iso_utc(ts) -> Column:
    """``datetime.isoformat()`` of a UTC timestamp: microseconds only when non-zero."""
    t = _c(ts).cast("timestamp_ntz")
    frac = F.date_format(t, "SSSSSS")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
                    F.lit("+00:00"))
