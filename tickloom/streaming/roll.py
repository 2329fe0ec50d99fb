"""Streaming metrics with late events rolled forward.

A watermark drops late rows before any operator of ours could see them, so this runs in ``foreachBatch``. Effective buckets
never decrease in arrival order, hence between micro-batches only one bucket is open: the one of the largest timestamp so
far. What a batch has to know is that bucket and its partial aggregates, one row per tag set.

Each batch reads the state folder of the batch before it, writes the buckets it closed to an output folder of its own and
its open bucket to a state folder of its own, and replaces both when it is retried. State folders of batches before the last two
are no longer read and are removed. Events without a time are in no bucket; they are counted in the report.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom import session
from tickloom.functions.buckets import NS_PER_MS
from tickloom.operators.arrival import roll_forward
from tickloom.operators.tagged import Metrics
from tickloom.options import AggregationOptions
from tickloom.sinks.formats import write_metrics

Writer = Callable[[DataFrame, str], None]
LATE = "_late"


def parquet_writer(path: str) -> Writer:
    """One folder per batch below ``path``."""
    return lambda metrics, batch: metrics.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def format_writer(spec: Metrics, options: AggregationOptions) -> Writer:
    """CSV or line protocol, one folder per batch."""
    return lambda metrics, batch: write_metrics(metrics, spec.measurement, list(spec.tags), spec.fields, options, batch) and None


@dataclass(frozen=True)
class RollingMetrics:
    """A measurement kept up to date from a stream. ``state_dir`` must be on storage that all executors share."""

    spec: Metrics
    window_ms: int
    state_dir: str
    write: Writer

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over ``stream``; arrival order is the order of the batches and ``spec.order`` within a batch."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.process)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = self._state(spark, batch_id - 1) if batch_id else None
        spec = replace(self.spec, adds={**self.spec.adds, LATE: F.lit(0).cast("bigint")})
        batch = batch.persist()  # read once; given back below
        untimed = batch.filter(F.col("ts_ns").isNull()).count()
        rolled = roll_forward(spec.rows(batch.filter(F.col("ts_ns").isNotNull())), self.window_ms * NS_PER_MS)
        if before is not None:
            carried = before.agg(F.max("bucket_ts")).first()[0]
            if carried is not None:
                rolled = rolled.withColumn("bucket_ts", F.greatest("bucket_ts", F.lit(carried)))
        rolled = rolled.withColumn(LATE, (F.col("own_bucket") < F.col("bucket_ts")).cast("bigint"))
        partials = spec.partial(rolled)
        if before is not None:
            partials = partials.unionByName(before)
        merged = session.materialize(spec.merge(partials))

        open_bucket = merged.agg(F.max("bucket_ts")).first()[0]
        is_open = F.col("bucket_ts") == F.lit(open_bucket)
        closed = spec.finish(merged.filter(~is_open))
        self.write(closed.drop(LATE), str(batch_id))
        merged.filter(is_open).write.mode("overwrite").parquet(f"{self.state_dir}/open/batch_id={batch_id}")
        report = closed.agg(
            F.coalesce(F.sum(LATE), F.lit(0)).alias("late_events"), F.count_distinct("bucket_ts").alias("flushes")
        )
        report = report.withColumn("untimed_events", F.lit(untimed).cast("bigint"))
        report.write.mode("overwrite").parquet(f"{self.state_dir}/report/batch_id={batch_id}")
        batch.unpersist()
        if batch_id > 1:
            session.remove_path(spark, f"{self.state_dir}/open/batch_id={batch_id - 2}")

    def finish(self, spark: SparkSession, last_batch: int | None) -> None:
        """Write the bucket still open after the last batch, under the name ``final``; nothing if the stream had no batch."""
        if last_batch is None or not session.path_exists(spark, f"{self.state_dir}/open/batch_id={last_batch}"):
            return
        spec = replace(self.spec, adds={**self.spec.adds, LATE: F.lit(0).cast("bigint")})
        rest = spec.finish(self._state(spark, last_batch))
        self.write(rest.drop(LATE), "final")
        report = rest.agg(
            F.coalesce(F.sum(LATE), F.lit(0)).alias("late_events"), F.count_distinct("bucket_ts").alias("flushes")
        )
        report = report.withColumn("untimed_events", F.lit(0).cast("bigint"))
        report.write.mode("overwrite").parquet(f"{self.state_dir}/report/batch_id=final")

    def report(self, spark: SparkSession) -> DataFrame:
        """Late events in the buckets written so far, and how many buckets that are."""
        parts = self._reports(spark)
        return parts.agg(F.sum("late_events").alias("late_events"), F.sum("flushes").alias("flushes"))

    def untimed(self, spark: SparkSession) -> DataFrame:
        """Events without a time, which are in no bucket."""
        return self._reports(spark).agg(F.sum("untimed_events").cast("bigint").alias("untimed_events"))

    def _reports(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", f"{self.state_dir}/report").parquet(f"{self.state_dir}/report")

    def _state(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.parquet(f"{self.state_dir}/open/batch_id={batch_id}")
