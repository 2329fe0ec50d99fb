import random

from pyspark.sql import functions as F

from tickloom.operators.tagged import Metrics
from tickloom.options import AggregationOptions
from tickloom.streaming import roll
from tickloom.streaming.keep import END, kept_series

SCHEMA = "recv_order bigint, ts_ns bigint, sym string, v bigint"


def serial(rows, period):
    seen, out = 0, {}
    for _, ts, sym, v in rows:
        seen = max(seen, ts)
        key = (sym, seen // period * period)
        total, _ = out.get(key, (0, None))
        out[key] = (total + v, v)
    return out


def test_roll_over_batches_with_a_retry(spark, tmp_path):
    rng = random.Random(8)
    clock, rows = 10**9, []
    for i in range(600):
        clock += rng.randint(0, 8_000_000)
        rows.append((i, clock - (rng.randint(0, 900_000_000) if rng.random() < 0.2 else 0), rng.choice("ab"), i))
    spec = Metrics("m", {"sym": "sym"}, adds={"total": "v"}, sets={"last": "v"})
    job = roll.RollingMetrics(spec, 100, str(tmp_path / "state"), roll.parquet_writer(str(tmp_path / "out")))
    cuts = [0, 50, 50, 300, 310, 600]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = spark.createDataFrame(rows[a:b], SCHEMA)
        job.process(batch, n)
        if n == 3:
            job.process(batch, n)
    job.finish(spark, len(cuts) - 2)
    got = {(r.sym, r.bucket_ts): (r.total, r.last) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = serial(rows, 100_000_000)
    assert got == want
    seen, late = 0, 0
    for _, ts, _, _ in rows:
        seen = max(seen, ts)
        late += ts // 10**8 < seen // 10**8
    assert job.report(spark).first()[:] == (late, len({b for _, b in want}))


def test_stream_to_line_files(spark, tmp_path):
    rows = [(i, 10**9 + i * 60_000_000, "a", 1) for i in range(20)]
    for n in range(2):
        part = spark.createDataFrame(rows[n * 10:n * 10 + 10], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spec = Metrics("ticks", {"sym": "sym"}, adds={"n": "v"})
    options = AggregationOptions(window_ms=100, output_dir=str(tmp_path / "out"), filename_prefix="p")
    job = roll.RollingMetrics(spec, 100, str(tmp_path / "state"), roll.format_writer(spec, options))
    query = job.start(stream, str(tmp_path / "checkpoint"), availableNow=True)
    query.awaitTermination()
    job.finish(spark, query.lastProgress["batchId"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "out" / "p_ticks.lp")).select("value").collect()]
    total = sum(int(line.split(" ")[1][2:-1]) for line in lines)
    assert total == 20 and all(line.startswith("ticks,sym=a n=") for line in lines)
    assert spark.read.text(str(tmp_path / "out" / "p_ticks.lp")).select(F.count_distinct("batch_id")).first()[0] >= 2


def test_events_without_a_time_are_counted(spark, tmp_path):
    spec = Metrics("m", {"sym": "sym"}, adds={"total": "v"})
    job = roll.RollingMetrics(spec, 100, str(tmp_path / "state"), roll.parquet_writer(str(tmp_path / "out")))
    job.process(spark.createDataFrame([(0, 10**9, "a", 1), (1, None, "a", 2)], SCHEMA), 0)
    job.process(spark.createDataFrame([(2, None, "b", 4), (3, 10**9 + 5, "a", 8)], SCHEMA), 1)
    job.finish(spark, 1)
    assert {(r.sym, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 9)}
    assert job.untimed(spark).first()[0] == 2


def test_keep_series_waits_for_whole_buckets_and_fills_idle_sets(spark, tmp_path):
    schema = "sym string, note string, bucket_ts bigint, v bigint"
    batches = [
        [("a", None, 100, 1)], [("b", "x", 100, 2), ("a", None, 300, 3)], [(None, None, 700, 4), ("c", "y, z", 700, 5)], [(None, None, END, None)],
    ]
    rows = [r for b in batches for r in b if r[2] < END]
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = kept_series(stream, ["sym", "note"], shards=3).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(repr, map(tuple, spark.read.parquet(str(tmp_path / "out")).select("sym", "note", "series_start", "bucket_ts", "v").collect())))
    starts = {}
    for sym, note, bucket, _ in rows:
        starts.setdefault((sym, note), bucket)
    want = [
        repr((*one, start, bucket, next((r[3] for r in rows if r[:3] == (*one, bucket)), None)))
        for one, start in starts.items() for bucket in (100, 300, 700) if bucket >= start
    ]
    assert got == sorted(want)


def test_a_stream_with_nothing_to_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    job = roll.RollingMetrics(Metrics("m", {"sym": "sym"}, adds={"total": "v"}), 100, str(tmp_path / "state"), roll.parquet_writer(str(tmp_path / "out")))
    query = job.start(stream, str(tmp_path / "c"), availableNow=True)
    query.awaitTermination()
    job.finish(spark, query.lastProgress["batchId"] if query.lastProgress else None)
    assert not (tmp_path / "out").exists()
