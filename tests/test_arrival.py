import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import arrival, prefix


def serial_roll(rows, period):
    """Event by event: the open bucket is the bucket of the largest timestamp so far."""
    seen, out = {}, {}
    for key, order, ts in sorted(rows, key=lambda r: r[1]):
        seen[key] = max(seen.get(key, ts), ts)
        out[order] = (ts // period * period, seen[key] // period * period)
    return out


def feed(spark, rows):
    return spark.createDataFrame(rows, "k string, recv_order bigint, ts_ns bigint")


def random_rows(seed, n=4000, spread=1, keys=3, jump=400):
    rng = random.Random(seed)
    clock, rows = 10_000, []
    for i in range(n):
        clock += rng.randint(0, 40)
        ts = clock - (rng.randint(0, jump * 5) if rng.random() < 0.3 else 0)
        rows.append((f"k{rng.randint(0, keys - 1)}", i * spread, ts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("spread", [1, 1000003])
@pytest.mark.parametrize("way", ["lookup", "limit", "crowded", "chunked"])
def test_roll_forward_equals_serial_model(spark, monkeypatch, spread, way):
    rows = random_rows(spread, spread=spread)
    df = feed(spark, rows)
    if way == "crowded":
        monkeypatch.setattr(arrival, "INTERVALS_PER_ROW", 0)
    if way == "chunked":
        got = arrival.roll_forward_chunked(df, 400, ["k"], chunk=64 * spread)
    else:
        got = arrival.roll_forward(df, 400, ["k"], limit=10 if way == "limit" else 1000, chunk=100 * spread)
    want = serial_roll(rows, 400)
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.own_bucket, r.bucket_ts) == want[r.recv_order]
        assert r.late == (r.own_bucket < r.bucket_ts)


def test_roll_forward_all_late_and_single_row(spark):
    df = feed(spark, [("a", 0, 5000)] + [("a", i, 5000 - 10 * i) for i in range(1, 200)])
    got = arrival.roll_forward(df, 100, ["k"]).collect()
    assert {r.bucket_ts for r in got} == {5000}
    assert arrival.roll_forward(feed(spark, [("a", 7, 123)]), 100).collect()[0].bucket_ts == 100
    assert arrival.roll_forward(feed(spark, []), 100).collect() == []


def test_late_trace(spark):
    p, b = 1_000_000_000, 1714041600_000_000_000
    trace = [(b, 1), (b + 1_000_000, 1), (b + p, 1), (b + p + 1_000_000, 1), (b + p // 2, 100)]
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(trace)], "recv_order bigint, ts_ns bigint, v bigint")
    rolled = arrival.roll_forward(df, p)
    sums = {r.bucket_ts: r.s for r in rolled.groupBy("bucket_ts").agg(F.sum("v").alias("s")).collect()}
    assert sums == {b: 2, b + p: 102}
    assert rolled.filter("late").count() == 1


@pytest.mark.parametrize("levels,chunk", [(1, 10), (2, 16), (2, 100000), (3, 7)])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running(spark, levels, chunk, exclusive):
    rng = random.Random(3)
    rows = [(f"k{rng.randint(0, 2)}", i - 500, rng.choice([None, rng.randint(-50, 50)])) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, o bigint, v int")
    got = prefix.running(df, ["k"], "o", {"s": ("sum", "v"), "m": ("max", "v"), "l": ("min", "v")}, exclusive, chunk, levels)
    seen = {}
    want = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        vals = seen.setdefault(k, [])
        before = list(vals)
        if v is not None:
            vals.append(v)
        use = before if exclusive else vals
        want[o] = (sum(use), max(use), min(use)) if use else (None, None, None)
    assert {r.o: (r.s, r.m, r.l) for r in got.collect()} == want


@pytest.mark.parametrize("levels,chunk", [(1, 10), (2, 16), (3, 5)])
@pytest.mark.parametrize("backwards", [False, True])
def test_following(spark, levels, chunk, backwards):
    rng = random.Random(9)
    orders = rng.sample(range(-1000, 3000), 600)
    rows = [(f"k{i % 3}", o, rng.choice([None, i])) for i, o in enumerate(orders)]
    df = spark.createDataFrame(rows, "k string, o bigint, v int")
    got = prefix.following(df, ["k"], "o", {"next": "v"}, backwards, chunk, levels)
    want = {}
    for key in ("k0", "k1", "k2"):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1], reverse=backwards)
        for a, b in zip(own, own[1:] + [(None, None, None)]):
            want[a[1]] = b[2]
    assert {r.o: r.next for r in got.collect()} == want


@pytest.mark.parametrize("way", ["lookup", "chunked"])
def test_rows_without_time_or_key(spark, way):
    """A row without a time is in no bucket and moves nothing; rows without a key are a feed of their own."""
    rows = [("a", 0, 5000), ("a", 1, None), ("a", 2, 100), (None, 3, 7000), (None, 4, 50), (None, 5, None), ("a", 6, 5100)]
    df = feed(spark, rows)
    roll = arrival.roll_forward if way == "lookup" else arrival.roll_forward_chunked
    got = {r.recv_order: (r.own_bucket, r.bucket_ts, r.late) for r in roll(df, 100, ["k"]).collect()}
    assert got == {
        0: (5000, 5000, False), 1: (None, None, False), 2: (100, 5000, True), 3: (7000, 7000, False), 4: (0, 7000, True),
        5: (None, None, False), 6: (5100, 5100, False),
    }
