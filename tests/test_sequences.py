"""Interval sets of received numbers, and the streams that keep them."""

import random
from decimal import Decimal

import pytest

from tickloom.streaming import sequences

SCHEMA = "connection_id bigint, recv_order bigint, msg_seq_num decimal(20,0), note string"


@pytest.mark.parametrize("seed", range(50))
def test_intervals_equal_a_set(seed):
    draw = random.Random(seed)
    kept, plain = sequences.Intervals(), set()
    for _ in range(draw.randrange(200)):
        n = draw.randrange(40)
        assert kept.add(n) == (n not in plain)
        plain.add(n)
    assert [n for s, e in zip(kept.starts, kept.ends) for n in range(s, e + 1)] == sorted(plain)
    assert all(e + 1 < s for e, s in zip(kept.ends, kept.starts[1:]))


def streamed(spark, tmp_path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


TOP = 2**64 - 1
BATCHES = [
    [(1, 0, Decimal(1), "a"), (1, 1, Decimal(2), "b"), (1, 3, Decimal(5), "c"), (2, 4, Decimal(TOP), "d"), (1, 2, Decimal(2), "copy"), (1, 9, None, "none")],
    [(1, 10, Decimal(4), "e"), (1, 11, Decimal(70_000), "f"), (2, 12, Decimal(TOP - 3), "g"), (1, 13, None, "none too")],
    [(1, 20, Decimal(1), "copy"), (2, 21, Decimal(TOP), "copy"), (1, 22, Decimal(3), "h"), (2, 23, Decimal(3), "i")],
]


def test_dedup_keeps_the_first_copy_for_ever(spark, tmp_path):
    stream = sequences.deduplicated_exactly(streamed(spark, tmp_path, BATCHES))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.note for r in got) == sorted(["a", "b", "c", "d", "none", "e", "f", "g", "none too", "h", "i"])


def test_gaps_close_when_late_frames_fill_them(spark, tmp_path):
    source, seen = streamed(spark, tmp_path, BATCHES[:2]), []
    for more in ([], BATCHES[2:]):
        for rows in more:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = sequences.tracked(source).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start().awaitTermination()
        gaps = sequences.gaps_of(sequences.received(spark, str(tmp_path / "c")))
        seen.append(sorted((r.connection_id, int(r.after_seq), int(r.before_seq), int(r.missing)) for r in gaps.collect()))
    assert seen[0] == [(1, 2, 4, 1), (1, 5, 70_000, 69_994), (2, TOP - 3, TOP, 2)]
    assert seen[1] == [(1, 5, 70_000, 69_994), (2, 3, TOP - 3, TOP - 7), (2, TOP - 3, TOP, 2)]
