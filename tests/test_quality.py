import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickloom.operators import quality
from tickloom.options import AggregationOptions, read_options
from tickloom.sources import connections


def messages(spark, seqs, connection=0):
    return spark.createDataFrame([(connection, i, s) for i, s in enumerate(seqs)], "connection_id bigint, recv_order bigint, msg_seq_num bigint")


def test_documented_gap_and_duplicate(spark):
    gaps = quality.seq_gaps(messages(spark, [1, 2, 3, 5, 6])).collect()
    assert [(r.after_seq, r.before_seq, r.missing) for r in gaps] == [(3, 5, 1)]
    copies = quality.seq_duplicates(messages(spark, [1, 2, 2, 3])).collect()
    assert [(r.seq, r.copies, r.first_order, r.last_order) for r in copies] == [(2, 2, 1, 2)]
    kept = quality.without_duplicates(messages(spark, [1, 2, 2, 3])).collect()
    assert sorted((r.recv_order, r.msg_seq_num) for r in kept) == [(0, 1), (1, 2), (3, 3)]


@pytest.mark.parametrize("chunk", [3, 50, 1 << 20])
def test_gaps_in_chunks(spark, chunk):
    rng = random.Random(chunk)
    rows, want = [], set()
    for c in range(3):
        present = sorted(rng.sample(range(1, 2000), 400))
        want |= {(c, a, b) for a, b in zip(present, present[1:]) if b > a + 1}
        arrive = present + rng.choices(present, k=50) + [present[7]] * 300
        rng.shuffle(arrive)
        rows += [(c, i, s) for i, s in enumerate(arrive)]
    df = spark.createDataFrame(rows, "connection_id bigint, recv_order bigint, msg_seq_num bigint")
    got = quality.seq_gaps(df, chunk=chunk).collect()
    assert {(r.connection_id, r.after_seq, r.before_seq) for r in got} == want
    assert all(r.missing == r.before_seq - r.after_seq - 1 for r in got)


def test_resume_is_the_latest_not_the_highest(spark):
    first = messages(spark, range(1, 1001))
    points = quality.resume_points(first)
    assert points.first().last_seq == 1000
    rest = quality.resume_scan(messages(spark, range(1, 2001)), points)
    assert rest.agg(F.min("msg_seq_num"), F.count("*")).first()[:] == (1001, 1000)
    assert quality.resume_points(messages(spark, [5, 9, 7])).first().last_seq == 7
    fresh = quality.resume_scan(messages(spark, [1, 2], connection=4), points)
    assert fresh.count() == 2


def test_counter_wrap(spark):
    rows = [(0, 0, str(2**64 - 11)), (0, 1, "5"), (0, 2, "5"), (0, 3, "9")]
    df = spark.createDataFrame(rows, "k int, o bigint, c string").withColumn("c", F.col("c").cast("decimal(20,0)"))
    got = {r.o: r.delta for r in quality.counter_delta(df, ["k"], "o", "c").collect()}
    assert got == {0: None, 1: 16, 2: 0, 3: 4}


def test_interval_report_with_idle_intervals(spark):
    s = 1_000_000_000
    df = spark.createDataFrame([(0, 125_000), (1 * s, 125_000), (16 * s, 250_000)], "recv_ns bigint, frame_len int")
    got = [tuple(r) for r in quality.stats_interval(df, 5).orderBy("interval_start").collect()]
    assert got == [(0, 2, 2, 250_000, 250_000, 0.4), (5 * s, 2, 0, 250_000, 0, 0.0), (10 * s, 2, 0, 250_000, 0, 0.0),
                   (15 * s, 3, 1, 500_000, 250_000, 0.4)]


def test_config(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({
        "connections": [
            {"host": "10.0.0.1", "port": 9000, "item": "stocks", "client_id": "A", "starting_seq": 7},
            {"endpoints": [{"host": "h1", "port": 1}, {"host": "h2", "port": 2}]}, {"host": "x"}, {},
        ],
        "aggregation": {"enabled": True, "window_ms": 500, "output_format": "csv"},
    }, indent=1))
    got = [tuple(r) for r in connections.read_connections(spark, str(path)).orderBy("connection_id").collect()]
    assert got == [(0, "10.0.0.1:9000", "stocks", "A", 7), (1, "h1:1", "default", "MsgClient", 0), (2, "x:8888", "default", "MsgClient", 0),
                   (3, "unknown", "default", "MsgClient", 0)]
    options = read_options(spark, str(path))
    assert (options.window_ms, options.csv, options.output_dir) == (500, True, "./output")
    path.write_text(json.dumps({"connections": [{"host": "x"}] * 65}))
    with pytest.raises(ValueError):
        connections.read_connections(spark, str(path))
    assert not read_options(spark, str(path)).enabled


@pytest.mark.parametrize("bad", [{"window_ms": 99}, {"window_ms": 3_600_001}, {"window_ms": 0}, {"output_dir": ""}, {"filename_prefix": ""}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        AggregationOptions(**bad)
    AggregationOptions(**{**bad, "enabled": False})
    AggregationOptions(window_ms=100), AggregationOptions(window_ms=3_600_000)


def test_gaps_over_the_full_unsigned_range(spark):
    seqs = [0, 1, 2**63 - 1, 2**63, 2**63 + 2, 2**64 - 1]
    rows = spark.createDataFrame([(1, Decimal(n)) for n in seqs], "connection_id int, msg_seq_num decimal(20,0)")
    got = sorted((int(r.after_seq), int(r.before_seq), int(r.missing)) for r in quality.seq_gaps(rows).collect())
    assert got == [(a, b, b - a - 1) for a, b in zip(seqs, seqs[1:]) if b - a > 1]


def test_interval_report_over_a_long_idle_time(spark):
    second = 1_000_000_000
    rows = spark.createDataFrame([(0, 10), (200_000 * second, 20)], "recv_ns bigint, frame_len int")
    got = quality.stats_interval(rows, 1)
    assert got.count() == 200_001
    assert got.filter("bytes_delta > 0").count() == 2
