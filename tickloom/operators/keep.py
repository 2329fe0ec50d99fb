"""Keep-series output: every tag set known so far reappears in every later bucket, with empty fields where idle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import session
from tickloom.operators import prefix


def keep_series(metrics: DataFrame, tags: Sequence[str], period_ns: int) -> DataFrame:
    """Rows of ``metrics`` plus a row for every tag set and every later bucket of the measurement without one.

    ``series_start`` is the first bucket of the tag set. The buckets are numbered, each tag set is expanded into the numbers
    from its first bucket on, and the values are joined on (tags, bucket): the work is that of writing the result.
    """
    metrics = session.materialize(metrics)
    found = metrics.select("bucket_ts").distinct().withColumns({
        "_step": F.call_function("div", F.col("bucket_ts"), F.lit(period_ns)), "_one": F.lit(1).cast("bigint"),
    })
    numbered = prefix.running(found, [], "_step", {"_n": ("sum", "_one")}).select("bucket_ts", "_n")
    numbered, _ = session.small_side(numbered)
    last = numbered.agg(F.max("_n")).first()[0] or 0

    starts = metrics.groupBy(*tags).agg(F.min("bucket_ts").alias("series_start"))
    first = numbered.select(F.col("bucket_ts").alias("series_start"), F.col("_n").alias("_first"))
    spans = starts.join(first, "series_start").select(*tags, "series_start", "_first", F.lit(last).cast("bigint").alias("_last"))
    series = prefix.expanded(spans, "_first", "_last", "_n").join(numbered, "_n").select(*tags, "series_start", "bucket_ts")
    fields = [c for c in metrics.columns if c not in (*tags, "bucket_ts")]
    s, m = series.alias("s"), metrics.alias("m")
    match = F.col("s.bucket_ts") == F.col("m.bucket_ts")
    for tag in tags:
        match = match & F.col(f"s.`{tag}`").eqNullSafe(F.col(f"m.`{tag}`"))
    return s.join(m, match, "left").select(
        *[F.col(f"s.`{c}`") for c in (*tags, "series_start", "bucket_ts")], *[F.col(f"m.`{c}`") for c in fields]
    )
