"""Metrics with any tags and fields, in long form, as line protocol or CSV whose columns come from the data.

Input is what :func:`tickloom.operators.tagged.aggregate_updates` gives: one row per field of a datapoint, tags as a MAP or as an ARRAY
of pairs. A datapoint is a (measurement, tags, ``bucket_ts``); its lines and rows are as large as its own tags and fields.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import session
from tickloom.functions import text
from tickloom.operators.tagged import tag_pairs, value_text
from tickloom.options import AggregationOptions
from tickloom.sinks import formats

# Names of tags and fields that one measurement may have as CSV columns.
MAX_COLUMNS = 5_000


def _is_set() -> Column:
    return F.coalesce(F.col("v_long").isNotNull() | F.col("v_double").isNotNull() | F.col("v_string").isNotNull(), F.lit(False))


def lines(values: DataFrame) -> DataFrame:
    """``measurement, line``: one line per datapoint with a field, tags and fields in order; a repeated tag key is repeated."""
    shown = F.coalesce(
        F.concat(F.col("v_long").cast("string"), F.lit("i")), text.fixed6(F.col("v_double")), text.line_string(F.col("v_string"))
    )
    fields = F.array_sort(F.collect_list(F.struct("field", shown.alias("text"))))
    points = values.filter(_is_set()).groupBy("measurement", tag_pairs(values).alias("pairs"), "bucket_ts").agg(fields.alias("fields"))
    head = F.transform("pairs", lambda p: F.concat(text.escape_tag(p["key"]), F.lit("="), text.escape_tag(F.coalesce(p["value"], F.lit("")))))
    body = F.transform("fields", lambda f: F.concat(text.escape_tag(f["field"]), F.lit("="), f["text"]))
    measured = F.concat_ws(",", text.escape_measurement(F.col("measurement")), head)
    return points.select("measurement", F.concat_ws(" ", measured, F.array_join(body, ","), F.col("bucket_ts").cast("string")).alias("line"))


@dataclass(frozen=True)
class Columns:
    """The tag and field names of a measurement, in order."""

    tags: tuple[str, ...]
    fields: tuple[str, ...]


def columns_of(values: DataFrame) -> dict[str, Columns]:
    """Names in use by measurement: the sorted union over all datapoints. More than ``MAX_COLUMNS`` of a measurement are an error."""
    tags = values.select("measurement", F.lit("tag").alias("kind"), F.explode(tag_pairs(values)["key"]).alias("name"))
    fields = values.select("measurement", F.lit("field").alias("kind"), F.col("field").alias("name"))
    named = session.materialize(tags.unionByName(fields).distinct())
    most = named.groupBy("measurement").count().agg(F.max("count"), F.count("*")).first()
    if most[0] and (most[0] > MAX_COLUMNS or most[1] > MAX_COLUMNS):
        raise ValueError(f"{most[1]} measurements with up to {most[0]} names of tags and fields; CSV columns are limited to {MAX_COLUMNS}")
    found: dict[str, dict[str, list[str]]] = {}
    for row in named.collect():
        found.setdefault(row.measurement, {"tag": [], "field": []})[row.kind].append(row.name)
    return {m: Columns(tuple(sorted(n["tag"])), tuple(sorted(n["field"]))) for m, n in sorted(found.items())}


def csv_table(values: DataFrame, measurement: str, columns: Columns) -> DataFrame:
    """``measurement, tag_*, field_*, time`` as text columns: NULL where a datapoint lacks a tag or field.

    Of a repeated tag key the least value is shown.
    """
    wide = values.filter(F.col("measurement") == measurement).groupBy(tag_pairs(values).alias("pairs"), "bucket_ts").agg(
        F.map_from_entries(F.collect_list(F.struct("field", value_text().alias("text")))).alias("fields")
    )
    first = lambda key: F.get(F.filter("pairs", lambda p: p["key"] == key), F.lit(0))["value"]
    return wide.select(
        F.lit(measurement).alias("measurement"), *[first(k).alias(f"tag_{k}") for k in columns.tags],
        *[F.try_element_at("fields", F.lit(f)).alias(f"field_{f}") for f in columns.fields], F.col("bucket_ts").cast("string").alias("time"),
    )


def csv_lines(values: DataFrame) -> DataFrame:
    """``measurement, line``: for each measurement the header and a line per datapoint."""
    parts = []
    for measurement, columns in columns_of(values).items():
        rows = csv_table(values, measurement, columns)
        header = rows.sparkSession.createDataFrame([(measurement,)], "measurement string").select(
            "measurement", F.concat_ws(",", *[text.csv_text(F.lit(c)) for c in rows.columns]).alias("line")
        )
        parts += [header, formats.csv_line(rows).select(F.lit(measurement).alias("measurement"), "line")]
    if not parts:
        return values.select("measurement", F.lit("").alias("line")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def write_values(values: DataFrame, options: AggregationOptions, batch_id: int | str, stamp: datetime | None = None) -> dict[str, str]:
    """Write one flush, a folder per measurement, and give the folders."""
    paths = {}
    for measurement, columns in columns_of(values).items():
        path = paths[measurement] = formats.batch_dir(options, measurement, batch_id, stamp)
        if options.csv:
            formats.write_csv(csv_table(values, measurement, columns), path)
        else:
            lines(values).filter(F.col("measurement") == measurement).select("line").write.mode("overwrite").text(path)
    return paths
