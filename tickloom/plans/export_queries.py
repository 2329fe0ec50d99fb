"""Output formats and text export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import session
from tickloom.functions import text
from tickloom.functions.buckets import bucket
from tickloom.functions.tags import tag_set
from tickloom.jobs import read_measurement, run_feed
from tickloom.operators import dump, market, tagged
from tickloom.options import AggregationOptions
from tickloom.plans import metric_queries, sql
from tickloom.plans.feed import HOUR_NS, feed, table
from tickloom.sinks import dynamic, formats
from tickloom.sources import wire
from tickloom.sources.frames import read_frames, union_connections

ORDER_FIELDS, TRADE_FIELDS, QUOTE_FIELDS = (market.FIELDS[name] for name in ("orders", "trades", "quotes"))


def _tags(name):
    return {c: market.TAG_NAMES[c] for c in market.TAGS[name]}


def line_protocol(spark, sf_dir):
    """All three measurements as lines."""
    parts = [
        formats.line_protocol(metrics(spark, sf_dir), name, _tags(name), fields)
        for name, metrics, fields in (
            ("orders", metric_queries.order_metrics, ORDER_FIELDS),
            ("trades", metric_queries.trade_metrics, TRADE_FIELDS),
            ("quotes", metric_queries.quote_metrics, QUOTE_FIELDS),
        )
    ]
    return reduce(DataFrame.unionByName, parts)


def csv_rows(spark, sf_dir):
    return formats.csv_rows(metric_queries.quote_metrics(spark, sf_dir), "quotes", _tags("quotes"), QUOTE_FIELDS)


def csv_lines(spark, sf_dir):
    """Conversation texts with commas and quotes as CSV lines."""
    rows = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn"), "role", "text",
        F.col("conv_id").alias("bucket_ts"),
    )
    return formats.csv_line(formats.csv_rows(rows, "talk", ["turn", "role"], ["text"]))


def tagged_texts(spark, sf_dir):
    """Page addresses as escaped tags and whole texts as string fields."""
    rows = table(spark, sf_dir, "pages").select(
        "url", F.concat(F.col("url"), F.lit(" = a, b")).alias("note"), "html", F.col("page_id").alias("bucket_ts")
    )
    return formats.line_protocol(rows, "web pages,raw", ["note", "url"], ["html"])


def text_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.printable(F.col("text")).alias("escaped"))


STATUS = {70: "Status::Filled", 79: "Status::Open"}


def nested_orders(spark, sf_dir):
    """Orders as nested rows: struct, array, map, pair, enum, character, fixed field and missing values."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    return o.select(
        "o_orderkey",
        F.struct(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderstatus").alias("flag", metadata={"char": True}),
            F.ascii("o_orderstatus").alias("status", metadata={"enum": {str(k): v for k, v in STATUS.items()}, "enum_name": "Status"}),
        ).alias("header", metadata={"type_name": "Header"}),
        F.col("o_orderpriority").alias("priority", metadata={"char_width": 16}),
        price.alias("price"),
        F.col("o_orderdate").alias("date"),
        (price > 100000).alias("large"),
        F.array(price, price / 8, price * 1000).alias("parts"),
        tag_set({"prio": "o_orderpriority", "cust": F.col("o_custkey")}).alias("tags"),
        F.struct(F.col("o_custkey").alias("first"), (price / 3).alias("second")).alias("quote"),
        F.when(F.col("o_custkey") % 3 != 0, F.struct(F.col("o_custkey").alias("key"))).alias("customer", metadata={"type_name": "Customer"}),
    )


def dump_text(spark, sf_dir):
    return dump.dump_text(nested_orders(spark, sf_dir), "order", keep=["o_orderkey"], type_name="Order")


def dump_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return dump.dump_text(events, keep=["event_id"], type_name="Event")


def activity(spark, sf_dir):
    """One measurement with tag sets of different keys and fields of all kinds, as long-form values."""
    rows = feed(spark, sf_dir).filter("msg_type in (1, 4)")
    new = F.col("msg_type") == 1
    tags = F.when(new, tag_set({"Instrument": "instrument", "Broker": "broker"})).otherwise(tag_set({"Instrument": "instrument", "Market": "market"}))
    update = lambda field, op, value, kind: F.struct(
        F.lit(field).alias("field"), F.lit(op).alias("op"), *[(value if k == kind else F.lit(None)).cast(t).alias(f"v_{k}")
        for k, t in (("long", "bigint"), ("double", "double"), ("string", "string"))],
    )
    updates = F.array(
        update("quantity", "add", F.col("quantity"), "long"),
        update("note", "set", F.when(new, F.concat(F.lit('to "'), "market", F.lit('", ok'))), "string"),
        update("last price", "set", F.when(~new, F.col("price")), "double"),
    )
    long = rows.select(
        F.when(F.col("recv_order") % 3 == 0, "activity").otherwise("other activity").alias("measurement"), tags.alias("tags"), "ts_ns", "recv_order",
        bucket(F.col("ts_ns"), 24 * HOUR_NS).alias("bucket_ts"), F.inline(updates),
    )
    return tagged.aggregate_updates(long.filter("v_long is not null or v_double is not null or v_string is not null"))


def metrics_lines(spark, sf_dir):
    return dynamic.lines(activity(spark, sf_dir))


def metrics_csv(spark, sf_dir):
    return dynamic.csv_lines(session.materialize(activity(spark, sf_dir)))


def tags_repeated(spark, sf_dir):
    """Datapoints with a tag key that occurs twice, written in changing order; through both sinks."""
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), F.col(value).alias("value"))
    there, back = F.array(pair("Venue", "market"), pair("Item", "instrument"), pair("Venue", "broker")), F.array(
        pair("Venue", "broker"), pair("Venue", "market"), pair("Item", "instrument"))
    rows = feed(spark, sf_dir).filter("msg_type = 4")
    base = rows.select(
        F.lit("venues").alias("measurement"), F.when(F.col("recv_order") % 2 == 0, there).otherwise(back).alias("tags"), "ts_ns", "recv_order",
        bucket(F.col("ts_ns"), 24 * HOUR_NS).alias("bucket_ts"), "quantity", "price",
    )
    common = ["measurement", "tags", "ts_ns", "recv_order", "bucket_ts"]
    none = lambda kind: F.lit(None).cast(kind)
    adds = base.select(*common, F.lit("volume").alias("field"), F.lit("add").alias("op"), F.col("quantity").alias("v_long"), none("double").alias("v_double"), none("string").alias("v_string"))
    sets = base.select(*common, F.lit("price").alias("field"), F.lit("set").alias("op"), none("bigint").alias("v_long"), F.col("price").alias("v_double"), none("string").alias("v_string"))
    values = session.materialize(tagged.aggregate_updates(adds.unionByName(sets)))
    lines, table_ = dynamic.lines(values), dynamic.csv_lines(values)
    return lines.select(F.lit("line").alias("sink"), "line").unionByName(table_.select(F.lit("csv").alias("sink"), "line"))


def _stored_frames(spark, sf_dir):
    """Frames of all connections as a stored table per connection, united when read."""
    root = session.scratch_path(spark, "frames")
    given = wire.encode(wire.wire_fields(feed(spark, sf_dir)))
    given.write.partitionBy("connection_id").parquet(root)
    parts = {c: read_frames(spark, f"{root}/connection_id={c}").drop("connection_id") for c in range(5)}
    return union_connections(parts)


def _job(spark, sf_dir, kind):
    options = AggregationOptions(window_ms=3_600_000, output_format=kind, output_dir=session.scratch_path(spark, "job"), filename_prefix="feed")
    run_feed(spark, _stored_frames(spark, sf_dir), options, exact_scale=2)
    return options


def job_files_csv(spark, sf_dir):
    """The whole job, its three CSV outputs read back as one table of text columns."""
    options = _job(spark, sf_dir, "csv")
    parts = [read_measurement(spark, options, name) for name in market.FIELDS]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def job_files_lines(spark, sf_dir):
    options = _job(spark, sf_dir, "influxdb_line")
    return reduce(DataFrame.unionByName, [read_measurement(spark, options, name) for name in market.FIELDS])


QUERIES = {
    "metrics_lines": metrics_lines,
    "metrics_csv": metrics_csv,
    "tags_repeated": tags_repeated,
    "job_files_csv": job_files_csv,
    "job_files_lines": job_files_lines,
    "line_protocol": line_protocol,
    "csv_rows": csv_rows,
    "csv_lines": csv_lines,
    "tagged_texts": tagged_texts,
    "text_escape": text_escape,
    "dump_text": dump_text,
    "dump_events": dump_events,
}


def _fixed6(x: str) -> str:
    return f"regexp_replace(printf('%.6f', {x}), '\\.?0+$', '')"


_DOUBLES = {"totalValue", "highPrice", "lowPrice", "bestBid", "bestAsk"}


def _line_sql(name: str, source: str, tags: list[str], fields: tuple[str, ...]) -> str:
    shown = sorted((market.TAG_NAMES[t], t) for t in tags)
    head = " || ".join([f"'{name}'"] + [f"',{label}=' || {c}" for label, c in shown])
    parts = ", ".join(
        f"'{f}=' || {_fixed6(f) if f in _DOUBLES else f + chr(32) + '|| ' + chr(39) + 'i' + chr(39)}" for f in sorted(fields)
    )
    return f"select {head} || ' ' || concat_ws(',', {parts}) || ' ' || bucket_ts as line from {source}"


def _quoted(x: str) -> str:
    return f"""'"' || replace(replace({x}, '\\', '\\\\'), '"', '\\"') || '"'"""


def _escaped(x: str) -> str:
    """Per character: named escapes, printable ASCII as it is, all other UTF-8 bytes in hex."""
    return f"""
list_aggregate(list_transform(string_split({x}, ''), lambda c:
  case when c = '\\' then '\\\\' when c = '"' then '\\"' when c = chr(10) then '\\n' when c = chr(13) then '\\r'
    when c = chr(9) then '\\t' when c between ' ' and '~' and octet_length(encode(c)) = 1 then c
    else regexp_replace(lower(hex(encode(c))), '(..)', '\\\\x\\1', 'g') end), 'string_agg', '')
"""


def _lines(*parts: str) -> str:
    return " || chr(10) || ".join(parts)


_DAY = 24 * sql.HOUR
_ACTIVITY = f"""
select case when recv_order % 3 = 0 then 'activity' else 'other activity' end as measurement, instrument,
  case when msg_type = 1 then broker end as broker, case when msg_type = 4 then market end as market, ts_ns // {_DAY} * {_DAY} as bucket_ts,
  cast(sum(quantity) as bigint) as quantity, arg_max('to "' || f.market || '", ok', recv_order) filter (msg_type = 1) as note,
  arg_max(price, recv_order) filter (msg_type = 4) as price
from feed f where msg_type in (1, 4) group by all
"""
_VENUES = f"""
select instrument, least(market, broker) as v1, greatest(market, broker) as v2, ts_ns // {_DAY} * {_DAY} as bucket_ts,
  cast(sum(quantity) as bigint) as volume, arg_max(price, recv_order) as price
from feed where msg_type = 4 group by all
"""


def _csv_sql(name: str, source: str, tags: list[str], fields: tuple[str, ...]) -> str:
    shown = ", ".join(f'{c} as "tag_{label}"' for label, c in sorted((market.TAG_NAMES[t], t) for t in tags))
    cells = ", ".join(f"{_fixed6(f) if f in _DOUBLES else f'cast({f} as varchar)'} as \"field_{f}\"" for f in sorted(fields))
    return f"select '{name}' as measurement, {shown}, {cells}, cast(bucket_ts as varchar) as time from {source}"


_ROLLED = {"measured": sql.MEASURED, "rolled": sql.rolled("measured")}
_PARTS = {n[0]: metric_queries._per(*metric_queries._SHAPES[n], "rolled") for n in ("order", "trade", "quote")}
_OUTPUTS = (
    ("orders", "o", ["market", "instrument", "broker"], ORDER_FIELDS), ("trades", "t", ["market", "instrument"], TRADE_FIELDS),
    ("quotes", "q", ["market", "instrument"], QUOTE_FIELDS),
)

_TRADE_B = "select market, instrument, bucket_ts, {agg} from b where msg_type = 4 group by all"

SQL = {
    "metrics_lines": sql.with_feed(
        f"""
select measurement, replace(measurement, ' ', '\\ ') || coalesce(',Broker=' || broker, '') || ',Instrument=' || instrument || coalesce(',Market=' || market, '')
  || ' ' || concat_ws(',', 'last\\ price=' || {_fixed6('price')}, 'note="' || replace(note, '"', '\\"') || '"', 'quantity=' || quantity || 'i') || ' ' || bucket_ts as line
from a
""",
        a=_ACTIVITY,
    ),
    "metrics_csv": sql.with_feed(
        f"""
select measurement, measurement || ',' || coalesce(broker, '') || ',' || instrument || ',' || coalesce(market, '') || ',' || coalesce({_fixed6('price')}, '')
  || ',' || coalesce('"' || replace(note, '"', '""') || '"', '') || ',' || quantity || ',' || bucket_ts as line from a
union all select measurement, 'measurement,tag_Broker,tag_Instrument,tag_Market,field_last price,field_note,field_quantity,time' from a group by measurement
""",
        a=_ACTIVITY,
    ),
    "tags_repeated": sql.with_feed(
        f"""
select 'line' as sink, 'venues,Item=' || instrument || ',Venue=' || v1 || ',Venue=' || v2 || ' price=' || {_fixed6('price')} || ',volume=' || volume || 'i ' || bucket_ts as line from v
union all select 'csv', 'venues,' || instrument || ',' || v1 || ',' || {_fixed6('price')} || ',' || volume || ',' || bucket_ts from v
union all select 'csv', 'measurement,tag_Item,tag_Venue,field_price,field_volume,time'
""",
        v=_VENUES,
    ),
    "job_files_csv": sql.with_feed(" union all by name ".join(_csv_sql(*o) for o in _OUTPUTS), **_ROLLED, **_PARTS),
    "job_files_lines": sql.with_feed(" union all ".join(_line_sql(*o) for o in _OUTPUTS), **_ROLLED, **_PARTS),
    "line_protocol": sql.with_feed(
        " union all ".join([
            _line_sql("orders", "o", ["market", "instrument", "broker"], ORDER_FIELDS),
            _line_sql("trades", "t", ["market", "instrument"], TRADE_FIELDS),
            _line_sql("quotes", "q", ["market", "instrument"], QUOTE_FIELDS),
        ]),
        b=metric_queries._BUCKETED,
        **{n[0]: metric_queries._per(*metric_queries._SHAPES[n], "b") for n in ("order", "trade", "quote")},
    ),
    "csv_rows": sql.with_feed(
        f"""
select 'quotes' as measurement, instrument as "tag_Instrument", market as "tag_Market",
  cast(askUpdates as varchar) as "field_askUpdates", {_fixed6('bestAsk')} as "field_bestAsk",
  cast(bestAskQty as varchar) as "field_bestAskQty", {_fixed6('bestBid')} as "field_bestBid",
  cast(bestBidQty as varchar) as "field_bestBidQty", cast(bidUpdates as varchar) as "field_bidUpdates",
  cast(bucket_ts as varchar) as time from q
""",
        b=metric_queries._BUCKETED, q=metric_queries._per(*metric_queries._SHAPES["quote"], "b"),
    ),
    "csv_lines": """
select 'talk,' || role || ',' || conv_id || ':' || turn || ','
  || case when regexp_matches(text, '[,"\\n\\r]') then '"' || replace(text, '"', '""') || '"' else text end
  || ',' || conv_id as line from conversations
""",
    "tagged_texts": f"""
select 'web\\ pages\\,raw,note=' || replace(replace(replace(url || ' = a, b', ',', '\\,'), '=', '\\='), ' ', '\\ ')
  || ',url=' || replace(replace(replace(url, ',', '\\,'), '=', '\\='), ' ', '\\ ')
  || ' html=' || {_quoted('html')} || ' ' || page_id as line
from pages where html is not null
""",
    "text_escape": f"select doc_id, coalesce({_escaped('text')}, '') as escaped from documents",
    "dump_text": "select o_orderkey, " + _lines(
        "'order = Order {'",
        "'  header = Header {'",
        "'    id = ' || o_orderkey",
        "'    flag = ''' || o_orderstatus || ''''",
        "'    status = ' || case o_orderstatus when 'F' then 'Status::Filled' when 'O' then 'Status::Open' "
        "else 'Status(' || ascii(o_orderstatus) || ')' end",
        "'  }'",
        "'  priority = \"' || o_orderpriority || '\" (' || length(o_orderpriority) || '/16)'",
        "'  price = ' || printf('%g', o_totalprice)",
        "'  date = ' || cast(o_orderdate as varchar)",
        "'  large = ' || case when o_totalprice > 100000 then 'true' else 'false' end",
        "'  parts = [3] {'",
        "'    [0] = ' || printf('%g', o_totalprice)",
        "'    [1] = ' || printf('%g', o_totalprice / 8)",
        "'    [2] = ' || printf('%g', o_totalprice * 1000)",
        "'  }'",
        "'  tags = [2] {'",
        "'    key = \"cust\"'",
        "'    val = \"' || o_custkey || '\"'",
        "'    key = \"prio\"'",
        "'    val = \"' || o_orderpriority || '\"'",
        "'  }'",
        "'  quote = ('",
        "'    first = ' || o_custkey",
        "'    second = ' || printf('%g', o_totalprice / 3)",
        "'  )'",
        "case when o_custkey % 3 = 0 then '  customer = (null)' else "
        + _lines("'  customer = Customer {'", "'    key = ' || o_custkey", "'  }'") + " end",
        "'}'",
    ) + " as text from orders",
    "dump_events": "select event_id, " + _lines(
        "'Event {'", "'  ts = ' || cast(ts as varchar)", "'  user_id = ' || user_id", "'  event_type = \"' || event_type || '\"'", "'  value = ' || printf('%g', value)",
        "'  props = \"' || replace(props, '\"', '\\\"') || '\"'", "'}'",
    ) + " as text from events",
}
