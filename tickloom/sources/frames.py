"""Frame tables: one row per captured frame, ``(connection_id, recv_order, frame)``."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom import session
from tickloom.operators import decode


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """A stored frame table. Partition it by connection or date when writing, so that filters prune files."""
    return spark.read.schema(S.FRAME_SCHEMA).parquet(path)


def stream_frames(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream of new files."""
    reader = spark.readStream.schema(S.FRAME_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def union_connections(parts: Mapping[int, DataFrame]) -> DataFrame:
    """Frames of several connections as one table; each part is tagged with its connection id."""
    if not 0 < len(parts) <= S.MAX_CONNECTIONS:
        raise ValueError(f"between 1 and {S.MAX_CONNECTIONS} connections are allowed, not {len(parts)}")
    tagged = [df.withColumn("connection_id", F.lit(cid).cast("bigint")) for cid, df in sorted(parts.items())]
    return reduce(DataFrame.unionByName, tagged)


def file_index(frames: DataFrame) -> DataFrame:
    """``connection_id, file, first_seq, last_seq, frames`` of a stored frame table: which response numbers each file holds.

    One row per file and connection; keep it beside the table and add the rows of new files as they are written.
    """
    placed = frames.select("connection_id", F.input_file_name().alias("file"), "frame")
    heads = decode.decode_heads(placed, contents=False)
    return heads.groupBy("connection_id", "file").agg(
        F.min("resp_seq").alias("first_seq"), F.max("resp_seq").alias("last_seq"), F.count("*").alias("frames")
    )


def resume_files(index: DataFrame, points: DataFrame) -> list[str]:
    """Files with frames after the resume point of one of their connections; of a connection without a point, all.

    As with any table of files, their names come to the driver.
    """
    points, _ = session.small_side(points.select("connection_id", "last_seq"), S.MAX_CONNECTIONS)
    known = index.select("connection_id", "file", F.col("last_seq").alias("_until")).join(points, "connection_id", "left")
    past = known.filter(F.col("last_seq").isNull() | (F.col("_until") > F.col("last_seq")))
    return sorted(row.file for row in past.select("file").distinct().collect())


def resume_frames(spark: SparkSession, path: str, index: DataFrame, points: DataFrame) -> DataFrame:
    """Frames of the table at ``path`` after the resume points, with their ``resp_seq``; files before the points are not opened."""
    files = resume_files(index, points)
    if not files:
        empty = spark.createDataFrame([], S.FRAME_SCHEMA)
        return empty.withColumn("resp_seq", F.lit(None).cast("decimal(20,0)"))
    frames = spark.read.schema(S.FRAME_SCHEMA).option("basePath", path).parquet(*files)
    heads = decode.decode_heads(frames)
    points, _ = session.small_side(points.select("connection_id", F.col("last_seq").alias("_last")), S.MAX_CONNECTIONS)
    joined = heads.join(points, "connection_id", "left").filter(F.col("_last").isNull() | (F.col("resp_seq") > F.col("_last")))
    return joined.select(*[f.name for f in S.FRAME_SCHEMA], "resp_seq")
