"""Streaming queries over the feed, replayed from files in arrival order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import session
from tickloom.operators.tagged import Metrics
from tickloom.plans import metric_queries, sql
from tickloom.plans.feed import feed, resent
from tickloom.schema import FEED_SCHEMA
from tickloom.streaming import handler, roll, sequences, windows
from tickloom.streaming.keep import END, kept_series

SLICES = 4
FILES = 4
NOW = {"availableNow": True}


def replay(spark, rows):
    """The rows as a stream of files, ``FILES`` per micro-batch; the slices are written one after another in arrival order."""
    path = session.scratch_path(spark, "feed")
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FEED_SCHEMA])
    lo, hi = rows.agg(F.min("recv_order"), F.max("recv_order")).first()
    width = (hi - lo) // SLICES + 1
    for i in range(SLICES):
        start = lo + i * width
        part = rows.filter(F.col("recv_order").between(start, start + width - 1))
        part.repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(FEED_SCHEMA).option("maxFilesPerTrigger", FILES).parquet(path)


def _finished(query):
    """Number of the last micro-batch; None if a stream had nothing to read."""
    query.awaitTermination()
    return query.lastProgress["batchId"] if query.lastProgress else None


def _trades(spec_rows):
    return spec_rows.filter("msg_type = 4")


def _rolling(spark):
    base = session.scratch_path(spark, "roll")
    spec = Metrics(
        "trades", {"Market": "market", "Instrument": "instrument"},
        adds={"numTrades": F.lit(1).cast("bigint"), "totalVolume": "quantity"}, sets={"lastPrice": "price"},
    )
    return base, roll.RollingMetrics(spec, metric_queries.HOUR_MS, f"{base}/state", roll.parquet_writer(f"{base}/out"))


def _roll(spark, sf_dir):
    base, job = _rolling(spark)
    stream = _trades(replay(spark, feed(spark, sf_dir)))
    job.finish(spark, _finished(job.start(stream, f"{base}/checkpoint", **NOW)))
    return base, job


def stream_roll_late(spark, sf_dir):
    base, _ = _roll(spark, sf_dir)
    return spark.read.parquet(f"{base}/out").drop("batch_id")


def stream_roll_report(spark, sf_dir):
    _, job = _roll(spark, sf_dir)
    return job.report(spark)


def stream_keep_series(spark, sf_dir):
    """Every known tag set at every flush of the rolled stream, the rolled buckets being the input of a second one."""
    base, job = _roll(spark, sf_dir)
    written = spark.read.parquet(f"{base}/out").drop("batch_id")
    end = spark.createDataFrame([(END,)], "bucket_ts long").select(
        *[F.col(c) if c == "bucket_ts" else F.lit(None).cast(t).alias(c) for c, t in written.dtypes]
    )
    end.write.mode("append").parquet(f"{base}/out/batch_id=zz-end")
    metrics = spark.readStream.schema(written.schema).parquet(f"{base}/out").drop("measurement", "batch_id")
    return _to_table(spark, kept_series(metrics, ["Market", "Instrument"]), "keep")


def _to_table(spark, stream, name, mode="append"):
    base = session.scratch_path(spark, name)
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(**NOW).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_drop_late(spark, sf_dir):
    """Hourly trades with Spark's watermark: late trades are dropped, the last hour stays open."""
    stream = _trades(replay(spark, feed(spark, sf_dir)))
    aggs = [F.count("*").alias("numTrades"), F.sum("quantity").alias("totalVolume")]
    return _to_table(spark, windows.closed_windows(stream, metric_queries.HOUR_MS, ["market", "instrument"], aggs), "drop")


def stream_dedup(spark, sf_dir):
    stream = windows.deduplicated(replay(spark, resent(feed(spark, sf_dir))), ["connection_id", "msg_seq_num"], "1 day")
    return _to_table(spark, stream.drop("event_time", "recv_order"), "dedup")


def delayed(spark, sf_dir):
    """The feed with some messages left out, some received out of order, and copies that come in the last slice, days of event time late."""
    rows = feed(spark, sf_dir)
    last = rows.agg(F.max("recv_order")).first()[0]
    order = F.col("recv_order")
    rows = rows.filter(order % 71 != 3).withColumn("recv_order", order + F.when(order % 53 == 4, last).otherwise(0))
    late = rows.filter(order % 37 == 1).withColumn("recv_order", order + 2 * last + 1)
    return rows.unionByName(late)


def stream_dedup_exact(spark, sf_dir):
    stream = sequences.deduplicated_exactly(replay(spark, delayed(spark, sf_dir)))
    return _to_table(spark, stream.drop("recv_order"), "dedup-exact")


def stream_seq_gaps(spark, sf_dir):
    """Gaps left when all slices are read; those that a late message fills are gone again."""
    base = session.scratch_path(spark, "gaps")
    stream = sequences.tracked(replay(spark, delayed(spark, sf_dir)))
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{base}/checkpoint").trigger(**NOW).start()
    query.awaitTermination()
    gaps = sequences.gaps_of(sequences.received(spark, f"{base}/checkpoint"))
    return gaps.select("connection_id", *[F.col(c).cast("bigint").alias(c) for c in ("after_seq", "before_seq", "missing")])


def _notional(messages, worker):
    out = messages[["recv_order", "connection_id"]].copy()
    out["notional"] = messages["price"] * messages["quantity"]
    return out


def handler_batch(spark, sf_dir):
    """A user function over every message."""
    return handler.handle(feed(spark, sf_dir), _notional, "recv_order bigint, connection_id bigint, notional double")


def stream_handler(spark, sf_dir):
    """A user function per micro-batch that keeps the message mix of the batch."""
    base = session.scratch_path(spark, "handler")

    def keep_mix(messages, batch_id):
        mix = messages.groupBy("connection_id", "msg_type").agg(F.count("*").alias("messages"))
        mix.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    _finished(handler.handle_stream(replay(spark, feed(spark, sf_dir)), keep_mix, f"{base}/checkpoint", **NOW))
    return spark.read.parquet(f"{base}/out").groupBy("connection_id", "msg_type").agg(F.sum("messages").alias("messages"))


QUERIES = {
    "stream_roll_late": stream_roll_late,
    "stream_roll_report": stream_roll_report,
    "stream_drop_late": stream_drop_late,
    "stream_dedup": stream_dedup,
    "stream_keep_series": stream_keep_series,
    "stream_dedup_exact": stream_dedup_exact,
    "stream_seq_gaps": stream_seq_gaps,
    "handler_batch": handler_batch,
    "stream_handler": stream_handler,
}

SQL = {
    "stream_roll_late": sql.with_feed(
        """
select 'trades' as measurement, market as "Market", instrument as "Instrument", bucket_ts, count(*) as numTrades,
  cast(sum(quantity) as bigint) as totalVolume, arg_max(price, recv_order) as lastPrice
from rolled where msg_type = 4 group by all
""",
        measured=sql.MEASURED, rolled=sql.rolled("measured"),
    ),
    "stream_roll_report": sql.with_feed(
        """
select cast(count(*) filter (where own_bucket < bucket_ts) as bigint) as late_events, count(distinct bucket_ts) as flushes
from rolled where msg_type = 4
""",
        measured=sql.MEASURED, rolled=sql.rolled("measured"),
    ),
    # What a watermark drops is fixed by the slices: in each, trades of hours that ended before the latest trade of the slices before.
    "stream_drop_late": sql.with_feed(
        f"""
select market, instrument, bucket_ts, count(*) as numTrades, cast(sum(quantity) as bigint) as totalVolume
from (
  select *, (select max(b.ts_ns // 1000000) from sliced b where b.slice < a.slice) as mark, max(ts_ns // 1000000) over () as last_mark
  from (select *, ts_ns - ts_ns % 3600000000000 as bucket_ts from sliced) a
)
where (bucket_ts // 1000000 + 3600000 > mark or mark is null) and bucket_ts // 1000000 + 3600000 <= last_mark
group by all
""",
        sliced=f"""
select *, (recv_order - (select min(recv_order) from feed))
  // ((select max(recv_order) - min(recv_order) from feed) // {SLICES} + 1) as slice
from feed where msg_type = 4
""",
    ),
    "stream_dedup": sql.with_feed(
        "select connection_id, msg_seq_num, ts_ns, msg_type, market, instrument, broker, price, quantity from feed"
    ),
    "stream_keep_series": sql.with_feed(
        """
select s.market as "Market", s.instrument as "Instrument", s.series_start, b.bucket_ts, a.numTrades, a.totalVolume, a.lastPrice
from (select market, instrument, min(bucket_ts) as series_start from a group by all) s
join (select distinct bucket_ts from a) b on b.bucket_ts >= s.series_start
left join a on a.market = s.market and a.instrument = s.instrument and a.bucket_ts = b.bucket_ts
""",
        measured=sql.MEASURED, rolled=sql.rolled("measured"),
        a="""select market, instrument, bucket_ts, count(*) as numTrades, cast(sum(quantity) as bigint) as totalVolume, arg_max(price, recv_order) as lastPrice
from rolled where msg_type = 4 group by all""",
    ),
    "stream_dedup_exact": sql.with_feed(
        "select connection_id, msg_seq_num, ts_ns, msg_type, market, instrument, broker, price, quantity from feed where recv_order % 71 <> 3"
    ),
    "stream_seq_gaps": sql.with_feed(
        "select connection_id, msg_seq_num as after_seq, n as before_seq, n - msg_seq_num - 1 as missing from (select *, "
        "lead(msg_seq_num) over (partition by connection_id order by msg_seq_num) as n from feed where recv_order % 71 <> 3) where n > msg_seq_num + 1"
    ),
    "handler_batch": sql.with_feed("select recv_order, connection_id, price * quantity as notional from feed"),
    "stream_handler": sql.with_feed("select connection_id, msg_type, count(*) as messages from feed group by all"),
}
