"""Event-time buckets on nanosecond BIGINTs (Spark timestamps stop at microseconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_MS = 1_000_000


def bucket(ts_ns: Column, period_ns: int) -> Column:
    """Start of the epoch-aligned tumbling bucket that holds ``ts_ns``."""
    return ts_ns - ts_ns % F.lit(period_ns)


def event_time(ts_ns: Column) -> Column:
    """TIMESTAMP for watermarks; the sub-microsecond part is cut."""
    return F.timestamp_micros(F.call_function("div", ts_ns, F.lit(1000)))
