"""The benchmark tables seen as a market feed.

``events`` becomes one message per row: five connections (one per region), sequence numbers with a gap after every 97
messages, two percent of the messages two hours late, all six typed messages, an ignored and an unknown type. The same
mapping is given as SQL for DuckDB, so that every query has an independent second form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> str:
    """SQL text: microseconds since the epoch of a timestamp without time zone, whatever the session's zone."""
    minutes = f"bigint(unix_date(date({ts})) * 1440 + hour({ts}) * 60 + minute({ts}))"
    return f"({minutes} * 60000000 + bigint(extract(second from {ts}) * 1000000))"


def from_events(events: DataFrame) -> DataFrame:
    """Feed rows of the given ``events`` rows (batch or stream)."""
    return events.selectExpr(
        "event_id as recv_order",
        "event_id % 5 as connection_id",
        "event_id div 5 + 1 + event_id div 5 div 97 as msg_seq_num",
        f"{micros('ts')} * 1000 - case when event_id % 49 = 7 then {2 * HOUR_NS} else 0 end as ts_ns",
        """case when event_id % 101 = 0 then 65 when event_id % 97 = 0 then 7 when event_type = 'signup' then 1
          when event_type = 'view' then 2 when event_type = 'error' then 3 when event_type = 'purchase' then 4
          when event_id % 2 = 0 then 5 else 6 end as msg_type""",
        "case user_id % 3 when 0 then 'NYSE' when 1 then 'NASDAQ' else 'LSE' end as market",
        """case user_id % 5 when 0 then 'AAPL' when 1 then 'MSFT' when 2 then 'GOOGL' when 3 then 'AMZN' else 'TSLA' end
          as instrument""",
        "case event_id % 3 when 0 then 'IB' when 1 then 'GS' else 'MS' end as broker",
        "value as price",
        "bigint(get_json_object(props, '$.k')) + 1 as quantity",
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def resent(feed_rows: DataFrame) -> DataFrame:
    """The feed with some messages received twice: a copy arrives right after its original."""
    copies = F.sequence(F.lit(0), F.when(F.col("recv_order") % 223 == 9, 1).otherwise(0))
    twice = feed_rows.withColumn("copy", F.explode(copies))
    return twice.withColumn("recv_order", F.col("recv_order") * 2 + F.col("copy")).drop("copy")


FEED_SQL = """
select event_id as recv_order, event_id % 5 as connection_id,
  event_id // 5 + 1 + event_id // 5 // 97 as msg_seq_num,
  epoch_us(ts) * 1000 - case when event_id % 49 = 7 then 7200000000000 else 0 end as ts_ns,
  case when event_id % 101 = 0 then 65 when event_id % 97 = 0 then 7 when event_type = 'signup' then 1
    when event_type = 'view' then 2 when event_type = 'error' then 3 when event_type = 'purchase' then 4
    when event_id % 2 = 0 then 5 else 6 end as msg_type,
  case user_id % 3 when 0 then 'NYSE' when 1 then 'NASDAQ' else 'LSE' end as market,
  case user_id % 5 when 0 then 'AAPL' when 1 then 'MSFT' when 2 then 'GOOGL' when 3 then 'AMZN' else 'TSLA' end as instrument,
  case event_id % 3 when 0 then 'IB' when 1 then 'GS' else 'MS' end as broker,
  value as price, cast(json_extract_string(props, '$.k') as bigint) + 1 as quantity
from events
"""

RESENT_SQL = """
select recv_order * 2 + copy as recv_order, connection_id, msg_seq_num, ts_ns, msg_type, market, instrument, broker, price, quantity
from feed, unnest(generate_series(0, case when recv_order % 223 = 9 then 1 else 0 end)) as c(copy)
"""
