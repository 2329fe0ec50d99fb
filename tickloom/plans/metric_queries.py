"""Windowed market metrics and tagged metrics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tickloom.functions.buckets import bucket
from tickloom.functions.tags import canonical
from tickloom.operators import keep, market, tagged
from tickloom.operators.arrival import roll_forward, roll_forward_chunked
from tickloom.plans import sql
from tickloom.plans.feed import HOUR_NS, feed, micros, table
from tickloom.schema import MEASUREMENTS

HOUR_MS = 3_600_000


def own_buckets(spark, sf_dir):
    return feed(spark, sf_dir).withColumn("bucket_ts", bucket(F.col("ts_ns"), HOUR_NS))


def measured(spark, sf_dir):
    rows = feed(spark, sf_dir).withColumn("measurement", market.measurement_of(F.col("msg_type")))
    return rows.filter("measurement is not null")


def rolled_feed(spark, sf_dir, name):
    return roll_forward(market.of_measurement(feed(spark, sf_dir), name), HOUR_NS)


def trade_metrics(spark, sf_dir):
    return market.trade_metrics(own_buckets(spark, sf_dir), exact_scale=2)


def order_metrics(spark, sf_dir):
    return market.order_metrics(own_buckets(spark, sf_dir))


def quote_metrics(spark, sf_dir):
    return market.quote_metrics(own_buckets(spark, sf_dir))


def late_rolled_trades(spark, sf_dir):
    return market.trade_metrics(rolled_feed(spark, sf_dir, "trades"), exact_scale=2)


def late_rolled_orders(spark, sf_dir):
    return market.order_metrics(rolled_feed(spark, sf_dir, "orders"))


def late_rolled_quotes(spark, sf_dir):
    return market.quote_metrics(rolled_feed(spark, sf_dir, "quotes"))


def late_rolled_two_level(spark, sf_dir):
    trades = market.of_measurement(feed(spark, sf_dir), "trades")
    return market.trade_metrics(roll_forward_chunked(trades, HOUR_NS, chunk=1 << 12), exact_scale=2)


def late_counts(spark, sf_dir):
    return market.late_counts(roll_forward(measured(spark, sf_dir), HOUR_NS, ["measurement"]))


def trade_value(spark, sf_dir):
    trades = market.of_measurement(feed(spark, sf_dir), "trades")
    return trades.select(
        "recv_order", market.trade_value(F.col("price"), F.col("quantity"), exact_scale=2).cast("double").alias("value")
    )


def merged_partials(spark, sf_dir):
    """Trades aggregated per connection first, the partials then merged."""
    spec = trade_spec()
    per_connection = replace(spec, tags={**spec.tags, "Connection": "connection_id"})
    rows = per_connection.rows(feed(spark, sf_dir).filter("msg_type = 4"))
    partials = per_connection.partial(rows.withColumn("bucket_ts", bucket(F.col("ts_ns"), HOUR_NS)))
    return spec.finish(spec.merge(partials)).select("Market", "Instrument", "bucket_ts", "numTrades", "totalVolume", "lastPrice")


def trade_spec():
    return tagged.Metrics(
        "trades", {"Market": "market", "Instrument": "instrument"},
        adds={"numTrades": F.lit(1).cast("bigint"), "totalVolume": "quantity"}, sets={"lastPrice": "price"},
    )


def shipment_spec():
    """User-defined metrics on shipped order lines; the arrival position is the line's key."""
    return tagged.Metrics(
        "shipments", {"Flag": "l_returnflag", "Status": "l_linestatus"},
        adds={"lines": F.lit(1).cast("bigint"), "quantity": F.col("l_quantity").cast("bigint")},
        sets={"lastPrice": "l_extendedprice", "lastPart": F.concat(F.lit("part "), F.col("l_partkey").cast("string"))},
        ts="ship_ns", order="line_key",
    )


# Order keys and line numbers repeat; with part, supplier and quantity a line has a number of its own.
LINE_KEY = """(l_orderkey * 8 + l_linenumber) * 1000000000
  + (l_partkey * 7919 + l_suppkey * 104729 + cast(l_quantity as bigint) * 15485863) % 1000000000"""


def user_metrics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumns({
        "ship_ns": F.expr(micros("l_shipdate")) * 1000,
        "line_key": F.expr(LINE_KEY),
    })
    return shipment_spec().aggregate(lines, HOUR_MS)


def _long(spark, sf_dir):
    """Updates of all three kinds over the trades, bucketed, tags written in varying order."""
    spec = tagged.Metrics(
        "feed", {"Market": "market", "Instrument": "instrument"},
        adds={"volume": "quantity", "value": F.col("price").cast("decimal(18,2)").cast("double")},
        sets={"lastPrice": "price", "lastBroker": "broker", "lastQty": "quantity"},
    )
    rows = feed(spark, sf_dir).filter("msg_type = 4")
    updates = spec.updates(rows).withColumn("bucket_ts", bucket(F.col("ts_ns"), HOUR_NS))
    swapped = F.create_map(
        F.lit("Market"), F.col("tags")["Market"], F.lit("Instrument"), F.col("tags")["Instrument"]
    )
    return updates.withColumn("tags", F.when(F.col("recv_order") % 2 == 0, swapped).otherwise(F.col("tags")))


def _flat(values):
    return values.select(
        "measurement", F.col("tags")["Market"].alias("market"), F.col("tags")["Instrument"].alias("instrument"),
        "bucket_ts", "field", "v_long", F.round("v_double", 4).alias("v_double"), "v_string",
    )


def metrics_long_add(spark, sf_dir):
    return _flat(tagged.aggregate_updates(_long(spark, sf_dir).filter("op = 'add'")))


def metrics_long_set(spark, sf_dir):
    return _flat(tagged.aggregate_updates(_long(spark, sf_dir).filter("op = 'set'")))


def _mixed(spark, sf_dir):
    """One field per tag set and bucket that is both set and added to: whole numbers, doubles and texts."""
    rows = feed(spark, sf_dir).filter("msg_type between 1 and 6")
    kind = F.col("msg_type")
    op = F.when(kind.isin(2, 5), "set").otherwise("add")
    as_double = kind.isin(4, 5)
    as_text = (kind == 2) & (F.col("quantity") % 4 == 0)
    half = F.col("quantity").cast("double") + 0.5
    none = F.lit(None)
    return rows.select(
        F.lit("mixed").alias("measurement"), tagged.tag_set({"Instrument": "instrument"}).alias("tags"), "recv_order",
        bucket(F.col("ts_ns"), HOUR_NS).alias("bucket_ts"), F.lit("level").alias("field"), op.alias("op"),
        F.when(~as_double & ~as_text, F.col("quantity")).alias("v_long"),
        F.when(as_double, half).otherwise(none).alias("v_double"),
        F.when(as_text, F.concat_ws(",", "broker", F.col("quantity").cast("string"))).alias("v_string"),
    )


def metrics_mixed(spark, sf_dir):
    values = tagged.aggregate_updates(_mixed(spark, sf_dir))
    return values.select(F.col("tags")["Instrument"].alias("instrument"), "bucket_ts", "v_long", "v_double", "v_string")


def metric_keys(spark, sf_dir):
    return tagged.metric_keys(_long(spark, sf_dir).unionByName(
        _mixed(spark, sf_dir).withColumn("ts_ns", F.col("bucket_ts"))
    ))


def metrics_pivot(spark, sf_dir):
    wide = tagged.pivot_fields(tagged.aggregate_updates(_long(spark, sf_dir)))
    tags = F.concat_ws(",", F.transform(F.map_entries(canonical(F.col("tags"))), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return wide.withColumn("tags", tags)


def keep_series(spark, sf_dir):
    trades = market.trade_metrics(rolled_feed(spark, sf_dir, "trades"), exact_scale=2)
    kept = keep.keep_series(trades, market.PRICE_TAGS, HOUR_NS)
    return kept.select("market", "instrument", "series_start", "bucket_ts", "numTrades", "totalVolume", "highPrice")


QUERIES = {
    "trade_metrics": trade_metrics,
    "order_metrics": order_metrics,
    "quote_metrics": quote_metrics,
    "late_rolled_trades": late_rolled_trades,
    "late_rolled_orders": late_rolled_orders,
    "late_rolled_quotes": late_rolled_quotes,
    "late_rolled_two_level": late_rolled_two_level,
    "late_counts": late_counts,
    "trade_value": trade_value,
    "merged_partials": merged_partials,
    "user_metrics": user_metrics,
    "metrics_long_add": metrics_long_add,
    "metrics_long_set": metrics_long_set,
    "metrics_mixed": metrics_mixed,
    "metric_keys": metric_keys,
    "metrics_pivot": metrics_pivot,
    "keep_series": keep_series,
}

_BUCKETED = f"select *, ts_ns // {sql.HOUR} * {sql.HOUR} as bucket_ts from feed where msg_type between 1 and 6"


def _per(agg: str, tags: str, kinds: str, source: str) -> str:
    return f"select {tags}, bucket_ts, {agg} from {source} where msg_type in ({kinds}) group by {tags}, bucket_ts"


def _kinds(name: str) -> str:
    return ", ".join(str(c) for c in MEASUREMENTS[name])


_SHAPES = {
    "trade": (sql.TRADE_AGG, "market, instrument", _kinds("trades")),
    "order": (sql.ORDER_AGG, "market, instrument, broker", _kinds("orders")),
    "quote": (sql.QUOTE_AGG, "market, instrument", _kinds("quotes")),
}
_LATE_TRADES = sql.with_feed(
    _per(*_SHAPES["trade"], "rolled"), measured=sql.MEASURED, rolled=sql.rolled("measured")
)
_TRADES_LONG = f"""
select market, instrument, recv_order, ts_ns // {sql.HOUR} * {sql.HOUR} as bucket_ts, price, quantity, broker
from feed where msg_type = 4
"""
_LONG_COLUMNS = "'feed' as measurement, market, instrument, bucket_ts"

SQL = {
    **{f"{n}_metrics": sql.with_feed(_per(*_SHAPES[n], "b"), b=_BUCKETED) for n in _SHAPES},
    **{
        f"late_rolled_{n}s": sql.with_feed(_per(*_SHAPES[n], "rolled"), measured=sql.MEASURED, rolled=sql.rolled("measured"))
        for n in _SHAPES
    },
    "late_rolled_two_level": _LATE_TRADES,
    "late_counts": sql.with_feed(
        """
select measurement, count(*) filter (where own_bucket < bucket_ts) as late_events,
  cast(sum(case when own_bucket < bucket_ts then
    case msg_type when 1 then 3 when 2 then 1 when 3 then 2 when 4 then 5 else 3 end else 0 end) as bigint) as late_updates,
  count(distinct bucket_ts) as flushes
from rolled group by measurement
""",
        measured=sql.MEASURED, rolled=sql.rolled("measured"),
    ),
    "trade_value": sql.with_feed(
        "select recv_order, cast(cast(price as decimal(18, 2)) * cast(quantity as decimal(10, 0)) as double) as value "
        "from feed where msg_type = 4"
    ),
    "merged_partials": sql.with_feed(
        """
select market as "Market", instrument as "Instrument", bucket_ts, count(*) as numTrades,
  cast(sum(quantity) as bigint) as totalVolume, arg_max(price, recv_order) as lastPrice
from b where msg_type = 4 group by all
""",
        b=_BUCKETED,
    ),
    "user_metrics": f"""
select 'shipments' as measurement, l_returnflag as "Flag", l_linestatus as "Status",
  open_ns // {sql.HOUR} * {sql.HOUR} as bucket_ts, count(*) as lines,
  cast(sum(cast(l_quantity as bigint)) as bigint) as quantity,
  arg_max(l_extendedprice, {LINE_KEY}) as lastPrice,
  arg_max('part ' || l_partkey, {LINE_KEY}) as lastPart
from (select *, max(epoch_us(l_shipdate) * 1000) over (order by {LINE_KEY} rows unbounded preceding) as open_ns from lineitem)
group by all
""",
    "metrics_long_add": sql.with_feed(
        f"""
select {_LONG_COLUMNS}, 'volume' as field, cast(sum(quantity) as bigint) as v_long, cast(null as double) as v_double,
  cast(null as varchar) as v_string from t group by all
union all
select {_LONG_COLUMNS}, 'value', null, round(sum(price), 4), null from t group by all
""",
        t=_TRADES_LONG,
    ),
    "metrics_long_set": sql.with_feed(
        f"""
select {_LONG_COLUMNS}, 'lastPrice' as field, cast(null as bigint) as v_long, arg_max(price, recv_order) as v_double,
  cast(null as varchar) as v_string from t group by all
union all
select {_LONG_COLUMNS}, 'lastBroker', null, null, arg_max(broker, recv_order) from t group by all
union all
select {_LONG_COLUMNS}, 'lastQty', arg_max(quantity, recv_order), null, null from t group by all
""",
        t=_TRADES_LONG,
    ),
    "metrics_mixed": sql.with_feed(
        """
select instrument, bucket_ts,
  case when base_s is null and base_d is null and coalesce(n_double, 0) = 0
    then coalesce(base_l, 0) + coalesce(add_l, 0) end as v_long,
  case when base_s is null and (base_d is not null or n_double > 0)
    then coalesce(base_d, 0.0) + coalesce(add_d, 0.0) + coalesce(base_l, 0) + coalesce(add_l, 0) end as v_double,
  case when base_s is not null then
    coalesce(list_reduce(list_prepend(base_s, texts), lambda a, t:
      case when regexp_matches(a, '[,"]') then '"' || replace(a, '"', '""') || '"' else a end || t), base_s) end as v_string
from (
  select b.instrument, b.bucket_ts, any_value(s.l) as base_l, any_value(s.d) as base_d, any_value(s.t) as base_s,
    cast(sum(a.l) as bigint) as add_l, sum(a.d) as add_d, count(a.d) as n_double,
    coalesce(list(coalesce(cast(a.l as varchar), cast(a.d as varchar)) order by a.recv_order)
      filter (where a.recv_order is not null), []) as texts
  from (select distinct instrument, bucket_ts from u) b
  left join (select instrument, bucket_ts, recv_order as at, l, d, t from u where is_set
    qualify row_number() over (partition by instrument, bucket_ts order by recv_order desc) = 1) s using (instrument, bucket_ts)
  left join (select * from u where not is_set) a
    on a.instrument = b.instrument and a.bucket_ts = b.bucket_ts and a.recv_order > coalesce(s.at, -1)
  group by b.instrument, b.bucket_ts
)
""",
        u=f"""
select instrument, recv_order, ts_ns // {sql.HOUR} * {sql.HOUR} as bucket_ts, msg_type in (2, 5) as is_set,
  case when msg_type not in (4, 5) and not (msg_type = 2 and quantity % 4 = 0) then quantity end as l,
  case when msg_type in (4, 5) then quantity + 0.5::double end as d,
  case when msg_type = 2 and quantity % 4 = 0 then broker || ',' || quantity end as t
from feed where msg_type between 1 and 6
""",
    ),
    "metric_keys": sql.with_feed(
        """
select distinct 'feed' as measurement, kind, name from feed,
  (values ('tag', 'Market'), ('tag', 'Instrument'), ('field', 'volume'), ('field', 'value'), ('field', 'lastPrice'),
    ('field', 'lastBroker'), ('field', 'lastQty')) k(kind, name) where msg_type = 4
union all
select distinct 'mixed', kind, name from feed, (values ('tag', 'Instrument'), ('field', 'level')) k(kind, name)
where msg_type between 1 and 6
"""
    ),
    "metrics_pivot": sql.with_feed(
        """
select 'feed' as measurement, 'Instrument=' || instrument || ',Market=' || market as tags, bucket_ts,
  arg_max(broker, recv_order) as lastBroker,
  regexp_replace(printf('%.6f', arg_max(price, recv_order)), '\\.?0+$', '') as lastPrice,
  cast(arg_max(quantity, recv_order) as varchar) as lastQty, cast(sum(quantity) as varchar) as volume,
  regexp_replace(printf('%.6f', cast(sum(cast(price as decimal(18, 2))) as double)), '\\.?0+$', '') as value
from t group by market, instrument, bucket_ts
""",
        t=_TRADES_LONG,
    ),
    "keep_series": sql.with_feed(
        """
select s.market, s.instrument, s.series_start, b.bucket_ts, a.numTrades, a.totalVolume, a.highPrice
from (select market, instrument, min(bucket_ts) as series_start from a group by all) s
join (select distinct bucket_ts from a) b on b.bucket_ts >= s.series_start
left join a on a.market = s.market and a.instrument = s.instrument and a.bucket_ts = b.bucket_ts
""",
        measured=sql.MEASURED, rolled=sql.rolled("measured"), a=_per(*_SHAPES["trade"], "rolled"),
    ),
}
