"""Frames, captures, stream statistics and sequence quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import session
from tickloom.functions.buckets import bucket
from tickloom.operators import decode, quality
from tickloom.operators.market import trade_metrics
from tickloom.plans import sql
from tickloom.plans.feed import HOUR_NS, feed, from_events, resent, table
from tickloom.sources import capture, wire
from tickloom.sources.connections import with_attributes
from tickloom.sources.frames import file_index, read_frames, resume_frames, union_connections

MINUTE = 60


def frames(spark, sf_dir):
    return wire.encode(wire.wire_fields(from_events(table(spark, sf_dir, "events"))))


def damaged(spark, sf_dir):
    """All frames, some cut to less than a frame head and some by their last byte."""
    at = F.col("recv_order")
    keep = F.when(at % 83 == 5, 20).when(at % 89 == 3, F.length("frame") - 1).otherwise(F.length("frame"))
    return frames(spark, sf_dir).withColumn("frame", F.substr("frame", F.lit(1), keep))


def connections(spark, sf_dir):
    """One connection per region."""
    name = F.replace(F.lower("r_name"), F.lit(" "), F.lit("-"))
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("bigint").alias("connection_id"),
        F.concat(name, F.lit(":"), (F.col("r_regionkey") + 8888).cast("string")).alias("endpoint"),
        F.col("r_name").alias("item"),
    )


def _whole(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def frame_decode(spark, sf_dir):
    heads = decode.decode_heads(frames(spark, sf_dir), contents=False)
    return _whole(heads, "resp_seq", "msg_seq_num")


def _typed(name, *wide):
    def query(spark, sf_dir):
        return _whole(decode.typed(frames(spark, sf_dir), name), "resp_seq", "msg_seq_num", *wide)

    return query


def frame_trade_metrics(spark, sf_dir):
    """From frames all the way to hourly trade metrics."""
    messages = decode.decode_feed(frames(spark, sf_dir), ["trades"]).withColumn("bucket_ts", bucket(F.col("ts_ns"), HOUR_NS))
    return trade_metrics(messages, exact_scale=2)


def frame_rejects(spark, sf_dir):
    return decode.frame_rejects(damaged(spark, sf_dir))


SEGMENT = 70_000


def stored_capture(spark, sf_dir):
    """The feed as segment files in the shared folder, cut without regard to frames."""
    path = session.scratch_path(spark, "capture")
    wire.store_segments(wire.segment_pieces(frames(spark, sf_dir), SEGMENT), path)
    return path


def capture_split(spark, sf_dir):
    found = capture.read_capture(spark, stored_capture(spark, sf_dir))
    return _whole(decode.decode_heads(capture.frames_of(found), contents=False), "resp_seq", "msg_seq_num")


def capture_feed(spark, sf_dir):
    """All fields the metrics use, from segment files."""
    found = capture.read_capture(spark, stored_capture(spark, sf_dir))
    return _whole(decode.decode_feed(capture.frames_of(found)).drop("recv_order"), "msg_seq_num")


def capture_errors(spark, sf_dir):
    """Segments of 64 frames each, some frames with a bad length, and the last frame of each connection cut short."""
    given = frames(spark, sf_dir)
    last = given.agg(F.max("recv_order")).first()[0]
    order, index = F.col("recv_order"), F.call_function("div", F.col("recv_order"), F.lit(5))
    bad = F.concat(F.lit(b"\x05\x00"), F.substr("frame", F.lit(3)))
    cut = F.substr("frame", F.lit(1), F.length("frame") - 7)
    data = F.when(index % 97 == 41, bad).when(order > last - 5, cut).otherwise(F.col("frame"))
    path = session.scratch_path(spark, "capture")
    pieces = given.select("connection_id", F.call_function("div", index, F.lit(64)).alias("segment_no"), order.alias("at"), data.alias("data"))
    wire.store_segments(pieces, path)
    return capture.parse_errors(capture.read_capture(spark, path))


def trade_labels(spark, sf_dir):
    return feed(spark, sf_dir).select("recv_order", decode.type_label(F.col("msg_type")).alias("label"))


def msg_mix(spark, sf_dir):
    return quality.message_mix(feed(spark, sf_dir))


def stats_global(spark, sf_dir):
    return quality.stats_global(damaged(spark, sf_dir))


def stats_connection(spark, sf_dir):
    return _whole(quality.stats_connection(damaged(spark, sf_dir), connections(spark, sf_dir)), "last_seq_num")


def stats_snapshot(spark, sf_dir):
    snapshot = quality.stats_snapshot(damaged(spark, sf_dir), connections(spark, sf_dir))
    flat = snapshot.select(
        F.col("messages_received").alias("total_received"), F.col("bytes_received").alias("total_bytes"),
        F.col("parse_errors").alias("total_errors"), F.inline("connection_stats"),
    )
    return _whole(flat, "last_seq_num")


def arrivals(spark, sf_dir):
    """Receive time (event time before the injected lateness) and frame length of every message."""
    kind = F.col("msg_type")
    body = F.when(kind.isin(1, 2), 128).when(kind == 3, 120).when(kind == 4, 112).when(kind.isin(5, 6), 88).otherwise(16)
    late = F.when(F.col("recv_order") % 49 == 7, 7_200_000_000_000).otherwise(0)
    return feed(spark, sf_dir).select("connection_id", (F.col("ts_ns") + late).alias("recv_ns"), (body + 24).alias("frame_len"))


def stats_interval(spark, sf_dir):
    return quality.stats_interval(arrivals(spark, sf_dir), MINUTE)


def counter_delta(spark, sf_dir):
    """The running message count of each connection as a 64-bit counter that wraps after 1000 messages."""
    samples = quality.stats_interval(arrivals(spark, sf_dir), 3600, keys=["connection_id"])
    start = F.lit(str(quality.TWO_64 - 1000)).cast("decimal(38,0)")
    counter = (start + F.col("received_total").cast("decimal(38,0)")) % F.lit(str(quality.TWO_64)).cast("decimal(38,0)")
    samples = samples.withColumns({
        "counter": counter.cast("decimal(20,0)"), "hour": F.call_function("div", F.col("interval_start"), F.lit(3600 * 10**9)),
    })
    deltas = quality.counter_delta(samples, ["connection_id"], "hour", "counter")
    return deltas.select("connection_id", "interval_start", F.col("counter").cast("string").alias("counter"), F.col("delta").cast("bigint").alias("delta"))


def seq_gaps(spark, sf_dir):
    return quality.seq_gaps(resent(feed(spark, sf_dir)))


def seq_duplicates(spark, sf_dir):
    return quality.seq_duplicates(resent(feed(spark, sf_dir)))


def seq_dedup(spark, sf_dir):
    return quality.without_duplicates(resent(feed(spark, sf_dir)))


def resume_points(spark, sf_dir):
    return quality.resume_points(resent(feed(spark, sf_dir)))


def resume_scan(spark, sf_dir):
    """What a reader that stopped half way through each connection still has to read."""
    messages = resent(feed(spark, sf_dir))
    half = quality.resume_points(messages).withColumn("last_seq", F.call_function("div", F.col("last_seq"), F.lit(2)))
    return quality.resume_scan(messages, half)


def stored_frames(spark, sf_dir):
    """The frame table as it is stored: by connection, in files of neighbouring frames."""
    path = session.scratch_path(spark, "frames")
    given = frames(spark, sf_dir).repartitionByRange(16, "recv_order").sortWithinPartitions("recv_order")
    given.write.partitionBy("connection_id").parquet(path)
    return path


def half_way(messages, seq):
    points = quality.resume_points(messages, seq)
    return points.withColumn("last_seq", F.call_function("div", F.col("last_seq").cast("bigint"), F.lit(2)))


def resume_files(spark, sf_dir):
    """From a stored frame table, what a reader that stopped half way still has to read; earlier files are not opened."""
    path = stored_frames(spark, sf_dir)
    table_ = read_frames(spark, path)
    points = half_way(decode.decode_heads(table_, contents=False), "resp_seq")
    left = resume_frames(spark, path, session.materialize(file_index(table_)), points)
    return _whole(left.drop("frame"), "resp_seq")


def stored_feed(spark, sf_dir):
    """Every typed message of a stored, partitioned frame table, and of a union of its connections read one by one."""
    path = stored_frames(spark, sf_dir)
    parts = {c: read_frames(spark, f"{path}/connection_id={c}").drop("connection_id") for c in range(5)}
    rows = decode.decode_feed(read_frames(spark, path)).withColumn("read", F.lit("table"))
    return _whole(rows.unionByName(decode.decode_feed(union_connections(parts)).withColumn("read", F.lit("union"))), "msg_seq_num")


def connection_attributes(spark, sf_dir):
    rows = with_attributes(feed(spark, sf_dir), connections(spark, sf_dir))
    return rows.groupBy("endpoint", "item", "msg_type").agg(F.count("*").alias("messages"))


QUERIES = {
    "frame_decode": frame_decode,
    "decode_trade": _typed("trade", "trade_id", "bid_order_id", "ask_order_id"),
    "decode_order_new": _typed("order_new", "order_id"),
    "decode_order_update": _typed("order_update", "order_id"),
    "decode_order_cancel": _typed("order_cancel", "order_id"),
    "decode_quotes": _typed("quote"),
    "frame_trade_metrics": frame_trade_metrics,
    "frame_rejects": frame_rejects,
    "capture_split": capture_split,
    "capture_feed": capture_feed,
    "capture_errors": capture_errors,
    "type_labels": trade_labels,
    "msg_mix": msg_mix,
    "stats_global": stats_global,
    "stats_connection": stats_connection,
    "stats_snapshot": stats_snapshot,
    "stats_interval": stats_interval,
    "counter_delta": counter_delta,
    "seq_gaps": seq_gaps,
    "seq_duplicates": seq_duplicates,
    "seq_dedup": seq_dedup,
    "resume_points": resume_points,
    "resume_scan": resume_scan,
    "resume_files": resume_files,
    "stored_feed": stored_feed,
    "connection_attributes": connection_attributes,
}

_WIRE = """
select *, ts_ns // 1000000000 as hdr_ts, cast(recv_order % 7 as integer) as flags,
  24 + case when msg_type in (1, 2) then 128 when msg_type = 3 then 120 when msg_type = 4 then 112
    when msg_type in (5, 6) then 88 else 16 end as len,
  case when quantity % 2 = 0 then 'B' else 'S' end as side
from feed
"""
_DAMAGED = "select *, case when recv_order % 83 = 5 then 20 when recv_order % 89 = 3 then len - 1 else len end as cut from w"
_PLACED = """
select *, cast(sum(len) over (partition by connection_id order by recv_order rows unbounded preceding) - len as bigint) as start from w
"""
# Segments are in order of number and connection; every 24 bytes have a number.
_SEGMENTS = """
select connection, segment_no, cast(sum((size + 23) // 24) over (order by segment_no, connection rows unbounded preceding) - (size + 23) // 24 as bigint) as base
from (select connection, segment_no, least(70000, total - 70000 * segment_no) as size
  from (select connection_id as connection, cast(sum(len) as bigint) as total from w group by all), unnest(generate_series(0, (total - 1) // 70000)) as s(segment_no))
"""
_CUT = """
select connection_id, segment_no, bad, last, cut,
  cast(sum(cut) over (partition by connection_id, segment_no order by recv_order rows unbounded preceding) - cut as bigint) as start,
  cast(sum(cut) over (partition by connection_id, segment_no) as bigint) as size
from (select connection_id, recv_order // 5 // 64 as segment_no, recv_order // 5 % 97 = 41 as bad, recv_order, last, len - case when last and recv_order // 5 % 97 <> 41 then 7 else 0 end as cut
  from (select *, recv_order > max(recv_order) over () - 5 as last from w))
"""
_COUNTERS = """
count(*) as messages_received, count(*) filter (where cut >= 24) as messages_decoded,
count(*) filter (where cut >= 24) as messages_processed, cast(sum(cut) as bigint) as bytes_received,
count(*) filter (where cut < 24) as parse_errors
"""
_CONNECTIONS = """
select cast(r_regionkey as bigint) as connection_id,
  replace(lower(r_name), ' ', '-') || ':' || (r_regionkey + 8888) as endpoint, r_name as item from region
"""
_PER_CONNECTION = f"""
select connection_id, {_COUNTERS},
  arg_max(case when cut >= 24 then msg_seq_num end, case when cut >= 24 then recv_order end) as last_seq_num
from d group by connection_id
"""
_TYPED = (
    "connection_id, recv_order, msg_seq_num as resp_seq, msg_seq_num, msg_type, msg_seq_num as body_seq, ts_ns, market, instrument"
)


def _decode_sql(columns: str, kinds: str) -> str:
    return sql.with_feed(f"select {_TYPED}, {columns} from w where msg_type in ({kinds})", w=_WIRE)


def _intervals(step: int, key: str) -> str:
    part, pick = ("", "") if not key else (f"partition by {key}", f"{key}, ")
    return f"""
select {pick}interval_start, cast(sum(n) over (w) as bigint) as received_total, n as received_delta,
  cast(sum(b) over (w) as bigint) as bytes_total, b as bytes_delta, b * 8.0::double / {step // 1000}.0::double as mbps
from (
  select {pick}k * {step} as interval_start, coalesce(n, 0) as n, coalesce(b, 0) as b
  from (select {pick}unnest(generate_series(min(recv_ns // {step}), max(recv_ns // {step}))) as k from a {'group by ' + key if key else ''})
  left join (select {pick}recv_ns // {step} as k, count(*) as n, cast(sum(len) as bigint) as b from a group by all) using ({pick}k)
) window w as ({part} order by interval_start)
"""


_ARRIVALS = "select *, ts_ns + case when recv_order % 49 = 7 then 7200000000000 else 0 end as recv_ns from w"

SQL = {
    "frame_decode": sql.with_feed(
        "select connection_id, recv_order, cast(len as integer) as resp_len, msg_seq_num as resp_seq, msg_seq_num, hdr_ts, flags, "
        "cast(len - 24 as integer) as body_len, case when msg_type > 7 then 0 else msg_type end as msg_type from w",
        w=_WIRE,
    ),
    "decode_trade": _decode_sql(
        "recv_order + 1 as trade_id, recv_order * 2 as bid_order_id, recv_order * 2 + 1 as ask_order_id, price, quantity, "
        "side as aggressor_side, 'R' as trade_condition", "4"
    ),
    "decode_order_new": _decode_sql(
        "broker, recv_order + 1 as order_id, price, quantity, side, case when quantity % 3 = 0 then 'M' else 'L' end as order_type", "1"
    ),
    "decode_order_update": _decode_sql(
        "broker, recv_order + 1 as order_id, price as new_price, quantity as new_quantity, quantity + 1 as old_quantity, side", "2"
    ),
    "decode_order_cancel": _decode_sql(
        "broker, recv_order + 1 as order_id, quantity as cancelled_qty, side, "
        "case when quantity % 5 = 0 then 'S' else 'U' end as cancel_reason", "3"
    ),
    "decode_quotes": _decode_sql("price, quantity, quantity // 2 as num_orders", "5, 6"),
    "frame_trade_metrics": sql.with_feed(
        f"select market, instrument, ts_ns // {sql.HOUR} * {sql.HOUR} as bucket_ts, {sql.TRADE_AGG} from feed where msg_type = 4 group by all"
    ),
    "frame_rejects": sql.with_feed(
        "select connection_id, recv_order, cast(cut as integer) as frame_len, "
        "case when cut < 24 then 'length' else 'short body' end as reason from d "
        "where cut < 24 or (cut < len and msg_type between 1 and 6)",
        w=_WIRE, d=_DAMAGED,
    ),
    "capture_split": sql.with_feed(
        "select connection_id, o.base + start % 70000 // 24 as recv_order, cast(len as integer) as resp_len, msg_seq_num as resp_seq, msg_seq_num, "
        "hdr_ts, flags, cast(len - 24 as integer) as body_len, case when msg_type > 7 then 0 else msg_type end as msg_type "
        "from p join o on p.connection_id = o.connection and start // 70000 = o.segment_no",
        w=_WIRE, p=_PLACED, o=_SEGMENTS,
    ),
    "capture_feed": sql.with_feed(
        "select connection_id, msg_seq_num, ts_ns, msg_type, market, instrument, case when msg_type <= 3 then broker end as broker, "
        "case when msg_type <> 3 then price end as price, quantity from feed where msg_type between 1 and 6"
    ),
    "capture_errors": sql.with_feed(
        "select connection_id, segment_no, coalesce(bad_at, final) as frame_offset, "
        "case when bad_at is null then 'incomplete' else 'bad length' end as problem, coalesce(size - bad_at, cut) as left_over from ("
        "  select connection_id, segment_no, min(start) filter (bad) as bad_at, max(start) as final, arg_max(cut, start) as cut, max(size) as size, bool_or(last) as last"
        "  from c group by all) where bad_at is not null or last",
        w=_WIRE, c=_CUT,
    ),
    "type_labels": sql.with_feed(
        "select recv_order, case msg_type when 1 then 'ORDER_NEW' when 2 then 'ORDER_UPDATE' when 3 then 'ORDER_CANCEL' "
        "when 4 then 'TRADE' when 5 then 'QUOTE_BID' when 6 then 'QUOTE_ASK' when 7 then 'INSTRUMENT_REF' "
        "else 'MarketDataType(' || msg_type || ')' end as label from feed"
    ),
    "msg_mix": sql.with_feed("select connection_id, msg_type, count(*) as messages from feed group by all"),
    "stats_global": sql.with_feed(f"select {_COUNTERS} from d", w=_WIRE, d=_DAMAGED),
    "stats_connection": sql.with_feed(
        "select p.*, endpoint, item from p left join c using (connection_id)", w=_WIRE, d=_DAMAGED, c=_CONNECTIONS, p=_PER_CONNECTION
    ),
    "stats_snapshot": sql.with_feed(
        f"select total_received, total_bytes, total_errors, p.*, endpoint, item from p left join c using (connection_id), "
        f"(select messages_received as total_received, bytes_received as total_bytes, parse_errors as total_errors "
        f"from (select {_COUNTERS} from d))",
        w=_WIRE, d=_DAMAGED, c=_CONNECTIONS, p=_PER_CONNECTION,
    ),
    "stats_interval": sql.with_feed(_intervals(60_000_000_000, ""), w=_WIRE, a=_ARRIVALS),
    "counter_delta": sql.with_feed(
        """
select connection_id, interval_start, cast(counter as varchar) as counter,
  cast((counter - lag(counter) over (partition by connection_id order by interval_start) + 18446744073709551616::hugeint)
    % 18446744073709551616::hugeint as bigint) as delta
from (select connection_id, interval_start,
  (18446744073709550616::hugeint + received_total) % 18446744073709551616::hugeint as counter from t)
""",
        w=_WIRE, a=_ARRIVALS, t=_intervals(3_600_000_000_000, "connection_id"),
    ),
    "seq_gaps": sql.with_feed(
        "select connection_id, msg_seq_num as after_seq, n as before_seq, n - msg_seq_num - 1 as missing from "
        "(select *, lead(msg_seq_num) over (partition by connection_id order by msg_seq_num) as n from resent) where n > msg_seq_num + 1",
        resent=sql.RESENT_SQL,
    ),
    "seq_duplicates": sql.with_feed(
        "select connection_id, msg_seq_num as seq, count(*) as copies, min(recv_order) as first_order, max(recv_order) as last_order "
        "from resent group by all having count(*) > 1",
        resent=sql.RESENT_SQL,
    ),
    "seq_dedup": sql.with_feed(
        "select * from resent qualify row_number() over (partition by connection_id, msg_seq_num order by recv_order) = 1",
        resent=sql.RESENT_SQL,
    ),
    "resume_points": sql.with_feed(
        "select connection_id, arg_max(msg_seq_num, recv_order) as last_seq from resent group by all", resent=sql.RESENT_SQL
    ),
    "resume_scan": sql.with_feed(
        "select r.* from resent r join (select connection_id, arg_max(msg_seq_num, recv_order) // 2 as last_seq from resent "
        "group by all) p using (connection_id) where msg_seq_num > last_seq",
        resent=sql.RESENT_SQL,
    ),
    "resume_files": sql.with_feed(
        "select w.connection_id, recv_order, msg_seq_num as resp_seq from w join (select connection_id, arg_max(msg_seq_num, recv_order) // 2 as last_seq "
        "from w group by all) p using (connection_id) where msg_seq_num > last_seq",
        w=_WIRE,
    ),
    "stored_feed": sql.with_feed(
        "select recv_order, connection_id, msg_seq_num, ts_ns, msg_type, market, instrument, case when msg_type <= 3 then broker end as broker, "
        "case when msg_type <> 3 then price end as price, quantity, read from feed, (values ('table'), ('union')) as r(read) where msg_type between 1 and 6"
    ),
    "connection_attributes": sql.with_feed(
        "select endpoint, item, msg_type, count(*) as messages from feed left join c using (connection_id) group by all", c=_CONNECTIONS
    ),
}
