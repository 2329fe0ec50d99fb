"""Connection attributes and job options from the JSON configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom import session

CONFIG_SCHEMA = """
connections array<struct<host string, port int, endpoints array<struct<host string, port int>>, item string,
  client_id string, starting_seq bigint>>,
aggregation struct<enabled boolean, window_ms bigint, output_format string, output_dir string, filename_prefix string>
"""

# What a connection entry means where it is silent
DEFAULT_PORT = 8888
DEFAULT_ITEM = "default"
DEFAULT_CLIENT = "MsgClient"
DEFAULT_START = 0


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONFIG_SCHEMA).json(path, multiLine=True)


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """One row per configured connection; its id is its place in the list, its endpoint the first one given."""
    entry = F.posexplode("connections").alias("connection_id", "c")
    rows = read_config(spark, path).select(entry)
    first = F.try_element_at(F.col("c.endpoints"), F.lit(1))
    host = F.coalesce(first["host"], F.col("c.host"))
    port = F.coalesce(F.when(first.isNotNull(), first["port"]), F.col("c.port"), F.lit(DEFAULT_PORT))
    checked = rows.select(
        F.col("connection_id").cast("bigint").alias("connection_id"),
        F.coalesce(F.concat(host, F.lit(":"), port.cast("string")), F.lit("unknown")).alias("endpoint"),
        F.coalesce("c.item", F.lit(DEFAULT_ITEM)).alias("item"),
        F.coalesce("c.client_id", F.lit(DEFAULT_CLIENT)).alias("client_id"),
        F.coalesce("c.starting_seq", F.lit(DEFAULT_START)).cast("bigint").alias("starting_seq"),
    )
    count = checked.count()
    if count > S.MAX_CONNECTIONS:
        raise ValueError(f"{count} connections configured, at most {S.MAX_CONNECTIONS} are allowed")
    return checked


def with_attributes(rows: DataFrame, connections: DataFrame) -> DataFrame:
    """Attach the attributes of the row's connection; broadcast while there are no more connections than allowed."""
    side, _ = session.small_side(connections, S.MAX_CONNECTIONS)
    return rows.join(side, "connection_id", "left")
