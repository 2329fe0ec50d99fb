"""Windowed metrics and deduplication with Spark's own watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.buckets import event_time


def with_event_time(stream: DataFrame, lateness: str, ts: str = "ts_ns") -> DataFrame:
    return stream.withColumn("event_time", event_time(F.col(ts))).withWatermark("event_time", lateness)


def closed_windows(
    stream: DataFrame, window_ms: int, keys: Sequence[str], aggs: Sequence[Column], lateness: str = "0 seconds"
) -> DataFrame:
    """Tumbling windows in append mode: a window is written once the watermark has passed its end.

    With no lateness a window closes when an event at or past its end has been seen, at micro-batch granularity. Later events
    for it are dropped (``numRowsDroppedByWatermark`` of the query's progress); :mod:`tickloom.streaming.roll` keeps them. The
    last window stays open when a stream ends.
    """
    timed = with_event_time(stream, lateness)
    grouped = timed.groupBy(F.window("event_time", f"{window_ms} milliseconds"), *keys).agg(*aggs)
    return grouped.withColumn("bucket_ts", F.unix_micros("window.start") * 1000).drop("window")


def deduplicated(stream: DataFrame, keys: Sequence[str], within: str) -> DataFrame:
    """First copy of every message; copies are recognised while they arrive no later than ``within`` apart in event time.

    The state holds one entry per key and is dropped behind the watermark.
    """
    return with_event_time(stream, within).dropDuplicatesWithinWatermark(list(keys))
