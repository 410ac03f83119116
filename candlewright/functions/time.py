"""Interval buckets and clocks. All times are UTC; nothing depends on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the supported intervals.
INTERVALS = {"1m": 60, "5m": 300, "30m": 1800}


def bucket_start(epoch_s: Column, seconds: Column | int) -> Column:
    """Start of the bucket that holds a second, rounding down for negative times too."""
    d = seconds if isinstance(seconds, Column) else F.lit(seconds).cast("long")
    return (epoch_s - F.pmod(epoch_s, d)).cast("long")


def bucket_close(start_s: Column, seconds: Column | int) -> Column:
    """Last second of a bucket."""
    d = seconds if isinstance(seconds, Column) else F.lit(seconds).cast("long")
    return (start_s + d - 1).cast("long")


def millis_to_ntz(ms: Column) -> Column:
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MILLISECOND", ms, zero)


def seconds_to_ntz(s: Column) -> Column:
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", s, zero)


def _millis(ts: Column, whole) -> Column:
    """timestampdiff would go through the session's time zone and its summer time; the interval does not."""
    since = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), since).cast("long")
    millis = whole(F.extract(F.lit("SECOND"), since) * 1000).cast("long")
    return part("DAY") * 86_400_000 + part("HOUR") * 3_600_000 + part("MINUTE") * 60_000 + millis


def ntz_to_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of an NTZ timestamp, digits beyond cut off."""
    return _millis(ts, F.floor)


def ntz_to_nearest_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of an NTZ timestamp, half of one rounded away from 1970, as epoch_ms of DuckDB has it."""
    return _millis(ts, F.round)


def truncate(ts: Column, seconds: int) -> Column:
    """Start of the bucket of an NTZ timestamp, as an NTZ timestamp."""
    return seconds_to_ntz(bucket_start(F.floor(ntz_to_millis(ts) / 1000).cast("long"), seconds))


def to_1m(ts: Column) -> Column:
    return truncate(ts, 60)


def to_5m(ts: Column) -> Column:
    return truncate(ts, 300)


def to_30m(ts: Column) -> Column:
    return truncate(ts, 1800)


def resolve_bucket(interval: str, ts: Column) -> Column:
    """Bucket of an NTZ timestamp in the named interval."""
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval!r}; known: {', '.join(INTERVALS)}")
    return truncate(ts, INTERVALS[interval])
