"""Late events: roll them forward into the bucket that is open when they arrive.

In arrival order, the open bucket is the bucket of the largest timestamp seen so far, and an event behind it is counted in
it: ``effective bucket = bucket(running max of ts_ns)``. The running max need not be computed row by row. A bucket is opened
by the first event that falls into it, so with one row per bucket (its first position in arrival order)

* bucket ``B`` is closed from ``closed_at(B)`` on, the smallest first position of any later bucket;
* the bucket open at position ``r`` is the largest one whose first position is at or before ``r``.

Both tables have one row per distinct bucket. While they are small (checked, see :func:`tickloom.session.small_side`) they are
broadcast, and the feed is rolled without shuffling or sorting its rows: on-time rows need one hash lookup by bucket, late
rows a second one by a chunk of the arrival axis. Otherwise the chunked running max of :mod:`tickloom.operators.prefix` does
it with one shuffle. The two give the same rows.

A row without a time has no bucket, is not late, and moves nothing. Rows with a NULL key are a feed of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom import session
from tickloom.functions.buckets import bucket
from tickloom.operators import prefix

# Most open-bucket intervals one late row may have to be compared with before the chunked running max is used instead.
INTERVALS_PER_ROW = 64


def roll_forward(
    df: DataFrame,
    period_ns: int,
    keys: Sequence[str] = (),
    ts: str = "ts_ns",
    order: str = "recv_order",
    limit: int = session.BROADCAST_ROWS,
    chunk: int = prefix.CHUNK,
) -> DataFrame:
    """Add ``own_bucket``, ``bucket_ts`` (effective) and ``late``.

    ``keys`` separate feeds with clocks of their own, such as ``measurement``; ``order`` is the unique arrival position.
    """
    own, feeds = _own(df, period_ns, keys, ts)
    openings, few = session.small_side(_openings(own, feeds, order), limit)
    if few:
        closing = session.materialize(_closing(openings, feeds))
        intervals = _open_intervals(closing, feeds)
        if intervals is not None:
            return _roll_by_lookup(own, df.columns, closing, *intervals, feeds, order)
    return roll_forward_chunked(df, period_ns, keys, ts, order, chunk)


def roll_forward_chunked(
    df: DataFrame,
    period_ns: int,
    keys: Sequence[str] = (),
    ts: str = "ts_ns",
    order: str = "recv_order",
    chunk: int = prefix.CHUNK,
) -> DataFrame:
    """:func:`roll_forward` by a running max over the rows: one shuffle, no assumption on the number of buckets."""
    own, feeds = _own(df, period_ns, keys, ts)
    seen = prefix.running(own, feeds, order, {"_open": ("max", "own_bucket")}, chunk=chunk)
    effective = F.when(F.col("own_bucket").isNotNull(), F.col("_open"))
    late = F.coalesce(F.col("own_bucket") < F.col("_open"), F.lit(False))
    return seen.select(*df.columns, "own_bucket", effective.alias("bucket_ts"), late.alias("late"))


def _own(df: DataFrame, period_ns: int, keys: Sequence[str], ts: str) -> tuple[DataFrame, list[str]]:
    """Add ``own_bucket``, and each key in a struct, which is never NULL itself."""
    feeds = [f"_feed_{k}" for k in keys]
    own = df.withColumn("own_bucket", bucket(F.col(ts), period_ns))
    return own.withColumns({f: F.struct(F.col(k).alias("key")) for f, k in zip(feeds, keys)}) if keys else own, feeds


def _openings(own: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First and last position of every bucket; combined on the map side, one row per bucket is shuffled."""
    return own.filter("own_bucket is not null").groupBy(*keys, "own_bucket").agg(F.min(order).alias("first_at"), F.max(order).alias("last_at"))


def _closing(openings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``closed_at``, the first position of any later bucket (NULL: never closed). Only for few buckets."""
    later = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    later = later.orderBy(F.desc("own_bucket")).rowsBetween(W.unboundedPreceding, -1)
    return openings.withColumn("closed_at", F.min("first_at").over(later))


def _open_intervals(closing: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int] | None:
    """Intervals of the arrival axis with the bucket open in them, spread over chunks of the axis, and the chunk width.

    Only buckets ahead of all earlier ones ever open: those first seen before any later bucket. Each stays open until
    ``closed_at``. The width is the mean interval length, so an interval lies in two chunks on average. None if the
    intervals crowd into few chunks.
    """
    opens = F.col("closed_at").isNull() | (F.col("first_at") < F.col("closed_at"))
    feeds = F.count_distinct(F.struct(*keys)) if keys else F.lit(1)
    size = closing.agg(
        F.count_if(opens).alias("n"), feeds.alias("feeds"), F.min("first_at").alias("start"), F.max("last_at").alias("end")
    ).first()
    if not size.n:
        return None
    width = max(1, -(-(size.end - size.start + 1) * size.feeds // size.n))
    until = F.coalesce("closed_at", F.lit(size.end + 1))
    slots = F.sequence(prefix.chunk_of(F.col("first_at"), width), prefix.chunk_of(until - 1, width))
    spread = closing.filter(opens).select(
        *keys, F.explode(slots).alias("slot"), "first_at", until.alias("closed_at"), "own_bucket"
    )
    most = spread.groupBy(*keys, "slot").count().agg(F.max("count")).first()[0]
    return (spread, width) if most <= INTERVALS_PER_ROW else None


def _roll_by_lookup(own, columns, closing, intervals, width, keys, order) -> DataFrame:
    ends = closing.select(*keys, "own_bucket", F.col("closed_at").alias("_closed"))
    known = own.join(F.broadcast(ends), [*keys, "own_bucket"], "left")
    known = known.withColumn("late", F.coalesce(F.col(order) >= F.col("_closed"), F.lit(False)))
    known = known.withColumn("_slot", F.when(F.col("late"), prefix.chunk_of(F.col(order), width)))

    spans = intervals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("slot").alias("_k_slot"),
        F.col("first_at").alias("_from"), F.col("closed_at").alias("_to"), F.col("own_bucket").alias("_open"),
    )
    match = F.col("_slot") == F.col("_k_slot")
    for k in keys:
        match = match & (F.col(k) == F.col(f"_k_{k}"))
    match = match & (F.col(order) >= F.col("_from")) & (F.col(order) < F.col("_to"))
    rolled = known.join(F.broadcast(spans), match, "left")
    effective = F.when(F.col("late"), F.col("_open")).otherwise(F.col("own_bucket"))
    return rolled.select(*columns, "own_bucket", effective.alias("bucket_ts"), "late")
