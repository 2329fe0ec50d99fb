"""The whole job: stored frames to files of all three measurements, flush by flush.

A flush writes one folder per measurement and then a manifest that names them. Readers go by the manifests, so they see all three
measurements of a flush or none of them, and a repeated flush replaces what its first attempt left.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import session
from tickloom.functions.buckets import NS_PER_MS
from tickloom.operators import decode, market
from tickloom.operators.arrival import roll_forward
from tickloom.options import AggregationOptions
from tickloom.sinks import formats

_MANIFEST = "batch_id string, written string, files map<string,string>"


def measure(frames: DataFrame, window_ms: int, exact_scale: int | None = None) -> DataFrame:
    """All metrics of a frame table: decoded once, late events rolled forward per measurement, one aggregate for all."""
    messages = decode.decode_feed(frames)
    measured = messages.withColumn("measurement", market.measurement_of(F.col("msg_type")))
    return market.all_metrics(roll_forward(measured, window_ms * NS_PER_MS, ["measurement"]), exact_scale)


def run_feed(
    spark: SparkSession, frames: DataFrame, options: AggregationOptions, batch_id: int = 0, stamp: datetime | None = None,
    exact_scale: int | None = None,
) -> str | None:
    """Measure ``frames`` and write one flush by ``options``; gives the manifest's path, or None if the job is switched off."""
    if not options.enabled:
        return None
    session.ship_package(spark)
    stamp = stamp or datetime.now(timezone.utc)
    metrics = session.materialize(measure(frames, options.window_ms, exact_scale))
    files = {}
    for name, fields in market.FIELDS.items():
        tags = {c: market.TAG_NAMES[c] for c in market.TAGS[name]}
        files[name] = formats.write_metrics(metrics.filter(F.col("measurement") == name), name, tags, fields, options, batch_id, stamp)
    return _publish(spark, options, batch_id, stamp, files)


def _manifest_dir(options: AggregationOptions) -> str:
    return f"{options.output_dir.rstrip('/')}/{options.filename_prefix}_flushes"


def _publish(spark: SparkSession, options: AggregationOptions, batch_id: int, stamp: datetime, files: dict[str, str]) -> str:
    """Write the manifest beside its place and move it there, on whatever storage it is."""
    said = json.dumps({"batch_id": str(batch_id), "written": stamp.isoformat(), "files": files})
    path = spark._jvm.org.apache.hadoop.fs.Path
    target, part = path(f"{_manifest_dir(options)}/{batch_id}.json"), path(f"{_manifest_dir(options)}/_{batch_id}-{uuid.uuid4().hex}")
    storage = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = storage.create(part)
    out.write(bytearray(said.encode()))
    out.close()
    storage.delete(target, False)
    if not storage.rename(part, target):
        raise OSError(f"cannot write {target}")
    return target.toString()


def flushes(spark: SparkSession, options: AggregationOptions) -> DataFrame:
    """``batch_id, written, files`` of every complete flush."""
    rows = spark.read.text(_manifest_dir(options), wholetext=True, pathGlobFilter="*.json")
    return rows.select(F.from_json("value", _MANIFEST).alias("flush")).select("flush.*")


def read_measurement(spark: SparkSession, options: AggregationOptions, measurement: str) -> DataFrame:
    """What complete flushes wrote of a measurement: text columns of CSV, or lines. One path per flush comes to the driver."""
    paths = [row[0] for row in flushes(spark, options).select(F.col("files")[measurement]).collect()]
    return formats.read_csv(spark, paths) if options.csv else spark.read.text(paths).withColumnRenamed("value", "line")
