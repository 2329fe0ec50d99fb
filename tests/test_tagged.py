import random

import pytest
from pyspark.sql import functions as F

from tickloom import session
from tickloom.functions.tags import tag_set
from tickloom.operators import keep, tagged
from tickloom.schema import UPDATE_SCHEMA


def trim(t):
    return t.rstrip("0").rstrip(".") if "." in t else t


def csv(v):
    if isinstance(v, float):
        return trim("%.6f" % v)
    if isinstance(v, int):
        return str(v)
    return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n\r') else v


def serial(updates):
    """Update by update."""
    values = {}
    for key, _, op, value in sorted(updates, key=lambda u: u[1]):
        if op == "set" or key not in values:
            values[key] = value
        elif isinstance(values[key], str):
            values[key] = csv(values[key]) + csv(value)
        else:
            values[key] = values[key] + value
    return values


@pytest.mark.parametrize("broadcast", [True, False])
def test_mixed_updates_equal_serial_model(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(session, "is_small", lambda *a: False)
    rng = random.Random(2)
    updates, rows = [], []
    for i in range(3000):
        key = (rng.choice("abc"), rng.randint(0, 9) * 100, rng.choice(["x", "y", "z", "w"]))
        op = "add" if rng.random() < 0.8 else "set"
        kind = rng.choice(["l", "l", "d"]) if op == "add" else rng.choice(["l", "d", "s"])
        if key[2] == "x":
            kind = "l"
        value = {"l": rng.randint(-9, 9), "d": rng.randint(-40, 40) / 4, "s": rng.choice(["up", "a,b", 'say "x"', ""])}[kind]
        updates.append((key, i, op, value))
        tags = {"k": key[0], "m": "1"} if i % 2 else {"m": "1", "k": key[0]}
        rows.append(("m", tags, key[1], i, key[2], op, value if kind == "l" else None, value if kind == "d" else None,
                     value if kind == "s" else None))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, UPDATE_SCHEMA).withColumn("bucket_ts", F.col("ts_ns"))
    got = {}
    for r in tagged.aggregate_updates(df).collect():
        got[(r.tags["k"], r.bucket_ts, r.field)] = next(v for v in (r.v_string, r.v_double, r.v_long, None) if v is not None)
    want = serial(updates)
    assert got == want
    assert all(type(got[k]) is type(want[k]) for k in want)


def test_wide_metrics_and_partials(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 5000), rng.choice("ab"), rng.choice([None, rng.randint(0, 9)]), rng.choice([None, "p", "q"])) for i in range(800)]
    df = spark.createDataFrame(rows, "recv_order bigint, ts_ns bigint, sym string, q bigint, s string")
    spec = tagged.Metrics("m", {"sym": "sym"}, adds={"q": "q"}, sets={"s": "s"})
    whole = spec.aggregate(df, window_ms=1, roll=False)
    part = lambda d: spec.partial(spec.rows(d).withColumn("bucket_ts", F.lit(0)))
    merged = spec.merge(part(df.filter("recv_order < 300")).unionByName(part(df.filter("recv_order >= 300"))))
    got = {r.sym: (r.q, r.s) for r in spec.finish(merged).collect()}
    assert got == {r.sym: (r.q, r.s) for r in whole.collect()}
    want = {}
    for i, _, sym, q, s in rows:
        old = want.get(sym, (None, None))
        want[sym] = (old[0] if q is None else (old[0] or 0) + q, s if s is not None else old[1])
    assert got == want
    with pytest.raises(ValueError):
        tagged.Metrics("m", {}, adds={"a": "q"}, sets={"a": "q"})


def test_keep_series_trace(spark):
    p, b = 500_000_000, 1714041600_000_000_000
    trace = [(b, 1), (b + 1_000_000, 2), (b + p, 3), (b + p + 1_000_000, 4), (b + 2 * p, 5)]
    df = spark.createDataFrame([(i, t, v, "AAPL") for i, (t, v) in enumerate(trace)] + [(9, b + 2 * p, 7, "MSFT")],
                               "recv_order bigint, ts_ns bigint, v bigint, sym string")
    spec = tagged.Metrics("orders", {"sym": "sym"}, adds={"count": "v"})
    kept = keep.keep_series(spec.aggregate(df.filter("sym = 'AAPL' or sym = 'MSFT'"), 500), ["sym"], p)
    got = sorted((r.sym, r.bucket_ts, r.series_start, r["count"]) for r in kept.collect())
    assert got == [("AAPL", b, b, 3), ("AAPL", b + p, b, 7), ("AAPL", b + 2 * p, b, 5), ("MSFT", b + 2 * p, b + 2 * p, 7)]


def test_keep_series_fills_idle_buckets(spark):
    rows = [("a", 100, 1), ("b", 300, 2), ("a", 700, 3), ("c", 700, 4)]
    kept = keep.keep_series(spark.createDataFrame(rows, "sym string, bucket_ts bigint, v bigint"), ["sym"], 100)
    got = sorted((r.sym, r.bucket_ts, r.v if r.v is not None else -1) for r in kept.collect())
    assert got == [("a", 100, 1), ("a", 300, -1), ("a", 700, 3), ("b", 300, 2), ("b", 700, -1), ("c", 700, 4)]


def test_keys_and_pivot(spark):
    values = spark.createDataFrame(
        [("m", {"a": "1"}, 0, "x", 5, None, None), ("m", {"a": "1"}, 0, "y", None, 1.50, None), ("m", {"b": "2"}, 0, "y", None, None, "t")],
        "measurement string, tags map<string,string>, bucket_ts bigint, field string, v_long bigint, v_double double, v_string string",
    )
    assert sorted((r.kind, r.name) for r in tagged.metric_keys(values).collect()) == [("field", "x"), ("field", "y"), ("tag", "a"), ("tag", "b")]
    wide = tagged.pivot_fields(values)
    assert wide.columns == ["measurement", "tags", "bucket_ts", "x", "y"]
    assert sorted((sorted(r.tags.items()), r.x or "", r.y) for r in wide.collect()) == [([("a", "1")], "5", "1.5"), ([("b", "2")], "", "t")]
    assert values.select(tag_set({"k": F.lit(1)}).alias("t")).first().t == {"k": "1"}


def test_keep_series_of_a_null_tag(spark):
    rows = spark.createDataFrame([(None, 0, 1), ("a", 10, 2), (None, 20, 3)], "sym string, bucket_ts bigint, v bigint")
    got = {(r.sym, r.bucket_ts): r.v for r in keep.keep_series(rows, ["sym"], 10).collect()}
    assert got == {(None, 0): 1, (None, 10): None, (None, 20): 3, ("a", 10): 2, ("a", 20): None}
