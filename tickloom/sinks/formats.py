"""Metric rows as line protocol or CSV, and as files per measurement and batch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import text
from tickloom.options import AggregationOptions


def _is_whole(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0)


def line_value(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text.line_string(value)
    return F.concat(value.cast("string"), F.lit("i")) if _is_whole(kind) else text.fixed6(value)


def csv_value(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return value
    return value.cast("string") if _is_whole(kind) else text.fixed6(value)


def _names(columns: Sequence[str] | Mapping[str, str]) -> list[tuple[str, str]]:
    """(output name, column) pairs in name order."""
    pairs = columns.items() if isinstance(columns, Mapping) else [(c, c) for c in columns]
    return sorted((shown, column) for column, shown in pairs)


def line_protocol(
    metrics: DataFrame, measurement: str, tags: Sequence[str] | Mapping[str, str], fields: Sequence[str] | Mapping[str, str],
    time: str = "bucket_ts",
) -> DataFrame:
    """One ``line`` per metric row: ``measurement,tag=v,… field=v,… time``, tags and fields in name order.

    NULL fields are left out, and a row without any field makes no line. ``tags`` and ``fields`` may map columns to names.
    """
    kinds = {f.name: f.dataType for f in metrics.schema}
    head = [text.escape_measurement(F.lit(measurement))]
    for shown, column in _names(tags):
        head.append(F.concat(text.escape_tag(F.lit(shown)), F.lit("="), text.escape_tag(F.col(column))))
    parts = [
        F.concat(text.escape_tag(F.lit(shown)), F.lit("="), line_value(F.col(column), kinds[column]))
        for shown, column in _names(fields)
    ]
    body = F.concat_ws(",", *parts)
    touched = reduce(or_, [F.col(column).isNotNull() for _, column in _names(fields)])
    line = F.concat_ws(" ", F.concat_ws(",", *head), body, F.col(time).cast("string"))
    return metrics.filter(touched).select(line.alias("line"))


def csv_rows(
    metrics: DataFrame, measurement: str, tags: Sequence[str] | Mapping[str, str], fields: Sequence[str] | Mapping[str, str],
    time: str = "bucket_ts",
) -> DataFrame:
    """``measurement, tag_*, field_*, time`` as text columns, names in order; NULL stays NULL (an empty value)."""
    kinds = {f.name: f.dataType for f in metrics.schema}
    return metrics.select(
        F.lit(measurement).alias("measurement"),
        *[F.col(column).alias(f"tag_{shown}") for shown, column in _names(tags)],
        *[csv_value(F.col(column), kinds[column]).alias(f"field_{shown}") for shown, column in _names(fields)],
        F.col(time).cast("string").alias("time"),
    )


def csv_line(rows: DataFrame) -> DataFrame:
    """The rows of :func:`csv_rows` as text lines, for sinks that take text."""
    parts = [F.coalesce(text.csv_text(F.col(c)), F.lit("")) for c in rows.columns]
    return rows.select(F.concat_ws(",", *parts).alias("line"))


def batch_dir(options: AggregationOptions, measurement: str, batch_id: int | str, stamp: datetime | None = None) -> str:
    """Folder of one flush: prefix, measurement, time of the flush if given, and the batch id as sequence number."""
    kind = "csv" if options.csv else "lp"
    root = f"{options.output_dir.rstrip('/')}/{options.filename_prefix}_{measurement}"
    return f"{root}.{kind}/batch_id={batch_id}" if stamp is None else f"{root}_{stamp:%y%m%d_%H%M%S}_{batch_id}.{kind}"


def write_metrics(
    metrics: DataFrame, measurement: str, tags, fields, options: AggregationOptions, batch_id: int | str, stamp: datetime | None = None,
) -> str:
    """Write one flush into a folder of its own. A retried batch replaces its own folder and touches no other."""
    path = batch_dir(options, measurement, batch_id, stamp)
    if options.csv:
        write_csv(csv_rows(metrics, measurement, tags, fields), path)
    else:
        line_protocol(metrics, measurement, tags, fields).write.mode("overwrite").text(path)
    return path


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def read_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """What :func:`write_csv` wrote, as text columns."""
    return spark.read.csv(
        list(paths), header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
