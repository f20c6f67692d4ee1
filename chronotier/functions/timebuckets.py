"""Epoch-aligned time buckets over LONG unix milliseconds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
MONTH_MS = 30 * DAY_MS


def check_width(width_ms: int) -> int:
    if width_ms <= 0:
        raise ValueError(f"bucket width must be positive, got {width_ms}")
    return int(width_ms)


def bucket_start(ts_ms: Column, width_ms: int) -> Column:
    """Start of the bucket of ``ts_ms``: the multiple of the width at or below it, also before 1970."""
    return ts_ms - F.pmod(ts_ms, F.lit(check_width(width_ms)).cast("long"))


def day_number(ts_ms: Column) -> Column:
    """Days since 1970-01-01 in UTC, floored also before 1970."""
    return F.expr("0L") + F.floor(bucket_start(ts_ms, DAY_MS) / F.lit(DAY_MS)).cast("long")


def to_millis(ts: Column) -> Column:
    """Unix milliseconds, floored, of a timestamp with or without time zone (session zone must be UTC)."""
    return F.unix_millis(ts.cast("timestamp"))
