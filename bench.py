"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Inputs are written once, outside the timing: each table in as many files as there are CPUs, and a frame table and capture files of
``COPIES`` times the feed. Every query is run twice and the second time counts, so that class loading and code generation are not
measured. All rows are computed and thrown away (``noop`` sink). Rates are rows of a query's own input per second.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tickloom.functions.buckets import bucket
from tickloom.operators import decode
from tickloom.operators.market import trade_metrics
from tickloom.plans import registry
from tickloom.plans.feed import HOUR_NS, from_events
from tickloom.session import ship_package, tuned
from tickloom.sources import capture, wire
from tickloom.sources.frames import read_frames

HEADLINE = (
    "trade_metrics order_metrics quote_metrics late_rolled_trades late_rolled_orders late_rolled_quotes late_rolled_two_level "
    "late_counts metrics_long_add metrics_long_set metrics_mixed keep_series user_metrics frame_decode decode_trade "
    "frame_trade_metrics capture_split seq_gaps seq_duplicates seq_dedup resume_scan stats_connection stats_interval "
    "line_protocol dump_text text_escape"
).split()
COPIES = 20
SEGMENT = 16 << 20
SOURCE = {"user_metrics": "lineitem", "dump_text": "orders", "text_escape": "documents"}


def stored_queries(spark: SparkSession, root: str, messages: int) -> dict:
    """Queries over a stored frame table and stored captures."""
    events = spark.read.parquet(f"{root}/events.parquet")
    many = events.crossJoin(spark.range(COPIES).withColumnRenamed("id", "_copy"))  # a few copies of a small table
    many = many.withColumn("event_id", F.col("event_id") + F.col("_copy") * messages).drop("_copy")
    frames = wire.encode(wire.wire_fields(from_events(many)))
    frames.repartitionByRange(16, "recv_order").write.parquet(f"{root}/frames")
    wire.store_segments(wire.segment_pieces(read_frames(spark, f"{root}/frames"), SEGMENT), f"{root}/capture")
    table = lambda: read_frames(spark, f"{root}/frames")
    return {
        "frame_decode": lambda: decode.decode_heads(table(), contents=False),
        "decode_trade": lambda: decode.typed(table(), "trade"),
        "frame_trade_metrics": lambda: trade_metrics(
            decode.decode_feed(table(), ["trades"]).withColumn("bucket_ts", bucket(F.col("ts_ns"), HOUR_NS)), exact_scale=2
        ),
        "capture_split": lambda: decode.decode_heads(capture.frames_of(capture.read_capture(spark, f"{root}/capture")), contents=False),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = (
        tuned(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", f"{scratch}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    root, rows = f"{scratch}/tables", {}
    for name in ("region", "orders", "lineitem", "events", "documents"):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        rows[name] = table.count()
        table.repartitionByRange(int(cpus), table.columns[0]).write.parquet(f"{root}/{name}.parquet")
    stored = stored_queries(spark, root, rows["events"])
    times, rates = {}, {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split():
        query = stored.get(name) or (lambda name=name: registry.QUERIES[name](spark, root))
        for _ in range(2):
            start = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        own = rows["events"] * COPIES if name in stored else rows[SOURCE.get(name, "events")]
        rates[name] = round(own / times[name])
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "messages": rows["events"],
        "stored_frames": rows["events"] * COPIES, "rows_per_sec": rates,
    }))


if __name__ == "__main__":
    main()
