"""Stream statistics and sequence quality.

Connections are few and may be very unequal, so nothing here sorts or collects a whole connection in one task: counters are
combinable aggregates, copies are reduced before anything is ordered, and order-dependent steps run in chunks of the
sequence axis (:mod:`tickloom.operators.prefix`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schema as S
from tickloom import session
from tickloom.functions import binary
from tickloom.operators import prefix
from tickloom.operators.decode import frame_length_ok
from tickloom.sources.connections import with_attributes

TWO_64 = 1 << 64
SEQ = "msg_seq_num"


def _counters() -> list[Column]:
    ok = frame_length_ok(F.col("frame"))
    return [
        F.count("*").alias("messages_received"),
        F.count_if(ok).alias("messages_decoded"),
        F.count_if(ok).alias("messages_processed"),
        F.coalesce(F.sum(F.length("frame")), F.lit(0)).cast("bigint").alias("bytes_received"),
        F.count_if(~ok).alias("parse_errors"),
    ]


def stats_global(frames: DataFrame) -> DataFrame:
    """One row: messages received, decoded and processed, bytes, parse errors."""
    return frames.agg(*_counters())


def stats_connection(frames: DataFrame, connections: DataFrame | None = None) -> DataFrame:
    """The counters per connection with its last sequence number and, if given, its endpoint and item."""
    last = F.max_by(F.when(frame_length_ok(F.col("frame")), binary.u64("frame", S.RESP_SEQ_AT)), F.col("recv_order"))
    stats = frames.groupBy("connection_id").agg(*_counters(), last.alias("last_seq_num"))
    return with_attributes(stats, connections) if connections is not None else stats


def stats_snapshot(frames: DataFrame, connections: DataFrame | None = None) -> DataFrame:
    """The global counters with an array of the per-connection rows, by connection id.

    Both levels come out of one pass: the global row adds up the per-connection rows, of which there are few.
    """
    per = stats_connection(frames, connections)
    total = [
        F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
        for c in ("messages_received", "messages_decoded", "messages_processed", "bytes_received", "parse_errors")
    ]
    first = ["connection_id", *[c for c in per.columns if c != "connection_id"]]
    return per.agg(*total, F.array_sort(F.collect_list(F.struct(*first))).alias("connection_stats"))


def stats_interval(
    rows: DataFrame, seconds: int, recv_ns: str = "recv_ns", length: str = "frame_len", keys: Sequence[str] = ()
) -> DataFrame:
    """Report per interval: running totals, what the interval added, and its rate in Mbit/s.

    Idle intervals between the first and the last one report too, with nothing added: one row with a time far from the others
    makes as many rows as there are intervals up to it, so filter such times first.
    """
    step = seconds * 1_000_000_000
    number = F.call_function("div", F.col(recv_ns), F.lit(step))
    busy = rows.groupBy(*keys, number.alias("n")).agg(
        F.count("*").alias("received_delta"), F.sum(F.col(length).cast("bigint")).alias("bytes_delta")
    )
    busy = session.materialize(busy)
    span = busy.groupBy(*keys) if keys else busy.groupBy()
    span = span.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).filter("lo is not null")
    every = prefix.expanded(span, "lo", "hi", "n").select(*keys, "n")
    filled = every.join(busy, [*keys, "n"], "left").fillna(0, ["received_delta", "bytes_delta"])
    total = prefix.running(
        filled, keys, "n", {"received_total": ("sum", "received_delta"), "bytes_total": ("sum", "bytes_delta")}
    )
    return total.select(
        *keys, (F.col("n") * step).alias("interval_start"), "received_total", "received_delta", "bytes_total", "bytes_delta",
        (F.col("bytes_delta") * F.lit(8.0) / F.lit(seconds * 1_000_000.0)).alias("mbps"),
    )


def counter_delta(samples: DataFrame, keys: Sequence[str], order: str, counter: str) -> DataFrame:
    """Increase of an unsigned 64-bit counter since the previous sample; right across the wrap from 2**64 - 1 to 0."""
    before = prefix.following(samples, keys, order, {"previous": counter}, backwards=True)
    wide = "decimal(38,0)"
    delta = F.pmod(F.col(counter).cast(wide) - F.col("previous").cast(wide), F.lit(str(TWO_64)).cast(wide))
    return before.withColumn("delta", delta.cast("decimal(20,0)"))


def message_mix(messages: DataFrame) -> DataFrame:
    """Messages per connection and type."""
    return messages.groupBy("connection_id", "msg_type").agg(F.count("*").alias("messages"))


def resume_points(messages: DataFrame, seq: str = SEQ) -> DataFrame:
    """Sequence number last received per connection: the latest to arrive, which need not be the highest."""
    return messages.groupBy("connection_id").agg(F.max_by(seq, "recv_order").alias("last_seq"))


def resume_scan(messages: DataFrame, points: DataFrame, seq: str = SEQ, starting: str | None = None) -> DataFrame:
    """Messages after the resume point of their connection.

    A connection without one starts after the column ``starting`` of ``points``, or from the beginning.
    """
    points, _ = session.small_side(points, S.MAX_CONNECTIONS)
    last = F.coalesce("last_seq", F.col(starting) if starting else F.lit(0), F.lit(0))
    joined = messages.join(points, "connection_id", "left")
    return joined.filter(F.col(seq) > last).select(*messages.columns)


def seq_gaps(messages: DataFrame, seq: str = SEQ, chunk: int = prefix.CHUNK) -> DataFrame:
    """Missing runs of sequence numbers per connection: after which number, before which, and how many.

    Copies are reduced to one row before the numbers are ordered, and the order runs in chunks of the number axis.
    """
    kind = messages.schema[seq].dataType
    unsigned = isinstance(kind, T.DecimalType)  # the full unsigned range, brought into that of a BIGINT for ordering
    shift = F.lit(str(1 << 63)).cast("decimal(20,0)")
    place = (F.col(seq).cast("decimal(20,0)") - shift).cast("bigint") if unsigned else F.col(seq).cast("bigint")
    received = messages.select("connection_id", place.alias("after_seq"))
    pairs = prefix.following(
        received.distinct(), ["connection_id"], "after_seq", {"before_seq": "after_seq"}, chunk=chunk, edges_from=received
    )
    if unsigned:
        back = {c: (F.col(c).cast("decimal(20,0)") + shift).cast("decimal(20,0)") for c in ("after_seq", "before_seq")}
        pairs = pairs.withColumns(back)
    missing = F.col("before_seq") - F.col("after_seq") - 1
    return pairs.filter(missing > 0).withColumn("missing", missing.cast("decimal(20,0)") if unsigned else missing)


def seq_duplicates(messages: DataFrame, seq: str = SEQ) -> DataFrame:
    """Numbers received more than once on a connection, how often, and when first and last."""
    copies = messages.groupBy("connection_id", F.col(seq).alias("seq")).agg(
        F.count("*").alias("copies"), F.min("recv_order").alias("first_order"), F.max("recv_order").alias("last_order")
    )
    return copies.filter("copies > 1")


def without_duplicates(messages: DataFrame, seq: str = SEQ) -> DataFrame:
    """The first copy to arrive of every message; ``recv_order`` tells copies apart.

    Only numbers and positions are shuffled, in a combinable aggregate. Numbers received more than once are few: their table is
    broadcast if its size allows, and the rows themselves are neither sorted nor moved.
    """
    copies = messages.groupBy(F.col("connection_id").alias("_connection"), F.col(seq).alias("_seq")).agg(
        F.min("recv_order").alias("_first"), F.count("*").alias("_copies")
    )
    repeated, _ = session.small_side(copies.filter("_copies > 1").drop("_copies"))
    same = F.col("connection_id").eqNullSafe(F.col("_connection")) & F.col(seq).eqNullSafe(F.col("_seq"))
    first = F.col("_first").isNull() | (F.col("recv_order") == F.col("_first"))
    return messages.join(repeated, same, "left").filter(first).select(*messages.columns)
