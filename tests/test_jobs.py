"""The whole job and its manifests, dynamic sinks, mergeable set/add states."""

import itertools
import random
from datetime import datetime

import pytest

from tickloom import jobs
from tickloom.operators import tagged
from tickloom.options import AggregationOptions
from tickloom.plans.feed import feed
from tickloom.sinks import dynamic, formats
from tickloom.sources import wire

VALUES = "measurement string, tags map<string,string>, bucket_ts bigint, field string, v_long bigint, v_double double, v_string string"


def options_in(path, **more):
    return AggregationOptions(**{"window_ms": 3_600_000, "output_format": "csv", "output_dir": str(path), "filename_prefix": "p", **more})


@pytest.fixture(scope="module")
def frames(spark, sf_dir):
    return wire.encode(wire.wire_fields(feed(spark, sf_dir).filter("recv_order < 400"))).persist()


def test_flushes_are_seen_whole_or_not_at_all(spark, frames, tmp_path, monkeypatch):
    options, stamp = options_in(tmp_path), datetime(2024, 4, 25, 12, 30, 1)
    first = frames.filter("recv_order < 200")
    jobs.run_feed(spark, first, options, 1, stamp)
    before = {m: jobs.read_measurement(spark, options, m).count() for m in ("orders", "trades", "quotes")}
    assert all(before.values())
    assert (tmp_path / "p_orders_240425_123001_1.csv").is_dir() and (tmp_path / "p_quotes_240425_123001_1.csv").is_dir()

    written = formats.write_metrics
    def failing(metrics, measurement, *rest):
        if measurement == "quotes":
            raise RuntimeError("lost")
        return written(metrics, measurement, *rest)
    monkeypatch.setattr(formats, "write_metrics", failing)
    with pytest.raises(RuntimeError):
        jobs.run_feed(spark, frames.filter("recv_order >= 200"), options, 2, stamp)
    assert before == {m: jobs.read_measurement(spark, options, m).count() for m in before}  # orders and trades of batch 2 are not seen

    monkeypatch.setattr(formats, "write_metrics", written)
    for _ in range(2):  # a repeated flush replaces the first
        jobs.run_feed(spark, frames.filter("recv_order >= 200"), options, 2, datetime(2024, 4, 25, 12, 30, 9))
    assert sorted(r.batch_id for r in jobs.flushes(spark, options).collect()) == ["1", "2"]
    after = {m: jobs.read_measurement(spark, options, m).count() for m in before}
    assert all(after[m] > before[m] for m in before)


def test_job_switched_off(spark, frames, tmp_path):
    assert jobs.run_feed(spark, frames, options_in(tmp_path / "x", enabled=False)) is None
    assert not (tmp_path / "x").exists()


def test_dynamic_sinks(spark, tmp_path):
    rows = [
        ("m", {"a": "1"}, 0, "x", 5, None, None), ("m", {"a": "1"}, 0, "y", None, 1.5, None), ("m", {"b": "2, 3"}, 0, "y", None, None, 't"'),
        ("m", {}, 9, "x", 1, None, None), ("m", {"b": "4"}, 9, "z", None, None, None), ("n 1", {"c d": "="}, 7, "f g", 2, None, None),
    ]
    values = spark.createDataFrame(rows, VALUES)
    assert sorted(r.line for r in dynamic.lines(values).collect()) == sorted([
        "m,a=1 x=5i,y=1.5 0", 'm,b=2\\,\\ 3 y="t\\"" 0', "m x=1i 9", "n\\ 1,c\\ d=\\= f\\ g=2i 7",
    ])
    got = {(r.measurement, r.line) for r in dynamic.csv_lines(values).collect()}
    assert got == {
        ("m", "measurement,tag_a,tag_b,field_x,field_y,field_z,time"), ("m", "m,1,,5,1.5,,0"), ("m", 'm,,"2, 3",,"t""",,0'), ("m", "m,,,1,,,9"),
        ("m", "m,,4,,,,9"), ("n 1", "measurement,tag_c d,field_f g,time"), ("n 1", "n 1,=,2,7"),
    }
    paths = dynamic.write_values(values, options_in(tmp_path), 3)
    back = formats.read_csv(spark, [paths["m"]])
    assert back.columns == ["measurement", "tag_a", "tag_b", "field_x", "field_y", "field_z", "time"]
    assert {(r.tag_b, r.field_y) for r in back.collect()} == {(None, "1.5"), ("2, 3", 't"'), (None, None), ("4", None)}
    lp = dynamic.write_values(values, options_in(tmp_path, output_format="influxdb_line"), 3)
    assert spark.read.text(lp["n 1"]).first()[0] == "n\\ 1,c\\ d=\\= f\\ g=2i 7"
    assert dynamic.csv_lines(values.limit(0)).count() == 0 and dynamic.lines(values.limit(0)).count() == 0


def test_too_many_columns_fail(spark, monkeypatch):
    monkeypatch.setattr(dynamic, "MAX_COLUMNS", 2)
    values = spark.createDataFrame([("m", {str(i): "v"}, 0, "x", 1, None, None) for i in range(3)], VALUES)
    with pytest.raises(ValueError, match="limited to 2"):
        dynamic.columns_of(values)


def serial(updates):
    base, added = None, 0
    for _, op, value in sorted(updates):
        base, added = (value, 0) if op == "set" else (base, added + value)
    return base, added


def state_of(updates):
    last = max((o for o, op, _ in updates if op == "set"), default=None)
    adds = [(o, v) for o, op, v in updates if op == "add" and (last is None or o > last)]
    base = next((v for o, _, v in updates if o == last), None)
    return tagged._State(last, (base, None, None), sum(v for _, v in adds) if adds else None, None,
                         min((o for o, _ in adds), default=None), max((o for o, _ in adds), default=None))


@pytest.mark.parametrize("seed", range(300))
def test_states_combine_in_any_order_or_say_that_they_cannot(seed):
    draw = random.Random(seed)
    updates = [(o, draw.choice(["add", "add", "set"]), draw.randint(1, 9)) for o in range(draw.randrange(1, 9))]
    cut = draw.randrange(len(updates) + 1) if seed % 2 else None
    parts = [updates[:cut], updates[cut:]] if cut is not None else [[u for u in updates if draw.random() < 0.5]]
    if cut is None:
        parts.append([u for u in updates if u not in parts[0]])
    if not all(parts):
        return
    for one, two in itertools.permutations(map(state_of, parts)):
        both = tagged.combined(one, two)
        if both is None:
            assert cut is None  # parts in order of arrival always combine
            continue
        assert (both.sets[0], both.add_long or 0) == serial(updates)


def test_numbers_appended_to_a_text_are_bounded(spark, monkeypatch):
    rows = [("m", {"k": "a"}, 0, 0, "f", "set", None, None, "start")] + [("m", {"k": "a"}, 0, i, "f", "add", i, None, None) for i in range(1, 6)]
    updates = spark.createDataFrame(
        rows, "measurement string, tags map<string,string>, bucket_ts long, recv_order long, field string, op string, v_long long, v_double double, v_string string"
    )
    assert tagged.aggregate_updates(updates).first().v_string == "start12345"
    monkeypatch.setattr(tagged, "MAX_APPENDED", 4)
    with pytest.raises(ValueError, match="5 numbers are added to one text"):
        tagged.aggregate_updates(updates)


def test_sums_beyond_a_bigint_fail(spark):
    rows = [("m", {"k": "a"}, 0, i, "f", "add", 2**62, None, None) for i in range(3)]
    updates = spark.createDataFrame(
        rows, "measurement string, tags map<string,string>, bucket_ts long, recv_order long, field string, op string, v_long long, v_double double, v_string string"
    ).coalesce(1)
    with pytest.raises(Exception, match="does not fit|overflow"):
        tagged.aggregate_updates(updates).collect()


def test_order_of_pairs_with_a_repeated_key_does_not_matter(spark):
    pairs = "array<struct<key: string, value: string>>"
    rows = [("m", [("k", "a"), ("k", "b")], 0, 1, "f", "add", 1, None, None), ("m", [("k", "b"), ("k", "a")], 0, 2, "f", "add", 2, None, None)]
    updates = spark.createDataFrame(
        rows, f"measurement string, tags {pairs}, bucket_ts long, recv_order long, field string, op string, v_long long, v_double double, v_string string"
    )
    values = tagged.aggregate_updates(updates)
    assert [(tuple(map(tuple, r.tags)), r.v_long) for r in values.collect()] == [((("k", "a"), ("k", "b")), 3)]
    assert dynamic.lines(values).first().line == "m,k=a,k=b f=3i 0"
