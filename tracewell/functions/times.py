"""Epoch nanoseconds and wall-clock text.  Nanoseconds stay longs; the session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000
EASTERN = "US/Eastern"


def _clock(seconds: Column, tz: str) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), tz), "yyyy-MM-dd HH:mm:ss")


def ns_to_text(ns: Column, tz: str = EASTERN) -> Column:
    """``yyyy-MM-dd HH:mm:ss.nnnnnnnnn`` in the zone."""
    seconds = (ns - F.pmod(ns, F.lit(NANOS))) / NANOS
    return F.concat(_clock(seconds.cast("long"), tz), F.lit("."), F.lpad(F.pmod(ns, F.lit(NANOS)).cast("string"), 9, "0"))


def sec_to_text(seconds: Column, tz: str = EASTERN) -> Column:
    return _clock(seconds, tz)


def text_to_sec(text: Column, tz: str = EASTERN) -> Column:
    """Seconds of a local ``yyyy-MM-dd HH:mm:ss``; null if it can't be read."""
    return F.unix_seconds(F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), tz))


def text_to_ns(text: Column, tz: str = EASTERN) -> Column:
    return text_to_sec(text, tz) * F.lit(NANOS)


def text_nanos_to_ns(text: Column, tz: str = EASTERN) -> Column:
    """Nanoseconds of a local time with a fraction of up to nine digits."""
    parts = F.split(text, r"\.")
    fraction = F.rpad(F.coalesce(F.get(parts, F.lit(1)), F.lit("0")), 9, "0")
    return text_to_ns(F.get(parts, F.lit(0)), tz) + fraction.cast("long")


def tick_series(start: Column, end: Column, minutes: int) -> Column:
    """Array of times from start on, every so many minutes, and the end."""
    step = F.expr(f"interval {minutes} minutes")
    inner = F.filter(F.sequence(start, end, step), lambda t: t < end)
    return F.concat(inner, F.array(end))


def local_day(ns: Column, tz: str = EASTERN) -> Column:
    """Day of the month of the local date."""
    return F.dayofmonth(F.from_utc_timestamp(F.timestamp_seconds(((ns - F.pmod(ns, F.lit(NANOS))) / NANOS).cast("long")), tz))
