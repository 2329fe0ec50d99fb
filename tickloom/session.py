"""Session settings and the two helpers that need the session: reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Size a broadcast side may have: rows, and bytes of the rows written as JSON.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

# Bytes of rows that go to a Python worker at a time, about. Spark bounds their number only, and 10 000 long texts, with what they become
# on the way, take some hundred MB on both sides.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

# Generated methods above this size are not compiled by the JVM; Spark then runs the operators one by one, which is faster.
COMPILED_METHOD_BYTES = 8000


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the jobs are written for; everything else is left to the cluster."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "256m")
        .config("spark.sql.codegen.hugeMethodLimit", COMPILED_METHOD_BYTES)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(_BATCH_SETTING, BATCH_BYTES)
        # Expressions here are built from many small columns; recording the Python call site of each costs milliseconds.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )


def prepare(spark: SparkSession) -> None:
    """What the jobs need of a session that was not made by :func:`tuned`; its settings are left alone."""
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; not needed where it is installed on the cluster."""
    context = spark.sparkContext
    if getattr(context, "_tickloom_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="package-"), "tickloom"), "zip", os.path.dirname(home), os.path.basename(home)
    )
    context.addPyFile(archive)
    context._tickloom_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers by bytes too, from now on in this session; a bound that is set already stays."""
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tickloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files: survives lost executors, cuts the lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of this library's own, on whatever storage it is; nothing happens if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def is_small(kept: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a materialized table is small enough to be broadcast: one count and sum, combined in the tasks that read it."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in kept.columns]))))
    rows, size = kept.agg(F.count("*"), size).first()
    return rows <= limit and (size or 0) <= BROADCAST_BYTES


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Materialize a reduced table and tell whether it is small; marked for broadcast only if it is.

    Past the limit the table comes back unmarked and the caller's join (or another way of its own) shuffles.
    """
    kept = materialize(df)
    small = is_small(kept, limit)
    return (F.broadcast(kept) if small else kept), small
