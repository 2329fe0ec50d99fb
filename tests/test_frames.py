import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.operators import decode
from tickloom.plans.feed import feed
from tickloom.sources import capture, frames as frame_tables, wire

FRAME = "connection_id bigint, recv_order bigint, frame binary"


def frame(seq, body=b"", length=None):
    return struct.pack("<HQQIH", 24 + len(body) if length is None else length, seq, seq, 0x12345678, 0) + body


def test_worked_example(spark):
    raw = bytes([0x18, 0x01]) + struct.pack("<QQ", 1, 1) + bytes([0x78, 0x56, 0x34, 0x12, 0, 0]) + bytes(range(65, 91)) * 9 + b"A" * 22
    assert len(raw) == 280
    r = decode.decode_heads(spark.createDataFrame([(0, 0, bytearray(raw))], FRAME)).first()
    assert (r.resp_len, int(r.resp_seq), int(r.msg_seq_num), r.hdr_ts, r.flags, r.body_len, r.msg_type) == (280, 1, 1, 0x12345678, 0, 256, 0)
    assert bytes(r.body) == raw[24:]
    assert S.HEAD_BYTES == 24 == S.MIN_FRAME


def test_rejects(spark):
    body = lambda code, size, ts=1: struct.pack("<B3xIQ", code, 1, ts) + b"\0" * (size - 16)
    rows = [
        (1, frame(1)[:23]), (2, frame(1, body(4, 112))), (3, frame(1, body(4, 111))), (4, frame(1, body(7, 16))),
        (5, frame(1, body(65, 16))), (6, frame(1, body(4, 112, 2**63))), (7, frame(1, b"\x04")), (8, frame(1)),
    ]
    df = spark.createDataFrame([(0, i, bytearray(f)) for i, f in rows], FRAME)
    got = {r.recv_order: r.reason for r in decode.frame_rejects(df).collect()}
    assert got == {1: "length", 3: "short body", 6: "timestamp"}
    assert [r.recv_order for r in decode.typed(df, "trade").orderBy("recv_order").collect()] == [2, 6]
    assert decode.typed(df, "trade").filter("recv_order = 6").first().ts_ns is None


def test_unterminated_field_stops_at_its_width(spark):
    body = bytearray(struct.pack("<B3xIQ", 4, 1, 5) + b"M" * 16 + b"AAPL" + b"\0" * 28 + b"\0" * 48)
    r = decode.typed(spark.createDataFrame([(0, 0, bytearray(frame(1, bytes(body))))], FRAME), "trade").first()
    assert (r.market, r.instrument, r.ts_ns) == ("M" * 16, "AAPL", 5)


def test_decode_gives_the_feed_back(spark, sf_dir):
    rows = feed(spark, sf_dir)
    frames = wire.encode(wire.wire_fields(rows))
    back = decode.decode_feed(frames)
    columns = [F.col(c).cast(t) for c, t in (("recv_order", "bigint"), ("connection_id", "bigint"), ("msg_seq_num", "bigint"),
               ("ts_ns", "bigint"), ("msg_type", "int"), ("market", "string"), ("instrument", "string"), ("quantity", "bigint"))]
    known = rows.filter("msg_type between 1 and 6")
    price = F.when(F.col("msg_type") != 3, F.col("price")).alias("price")
    broker = F.when(F.col("msg_type") < 4, F.col("broker")).alias("broker")
    a, b = known.select(*columns, price, broker), back.select(*columns, price, broker)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_union_and_stored_frames(spark, tmp_path):
    one = spark.createDataFrame([(0, 1, bytearray(frame(1)))], FRAME)
    both = frame_tables.union_connections({3: one, 1: one})
    both.write.parquet(str(tmp_path / "f"))
    assert sorted(r.connection_id for r in frame_tables.read_frames(spark, str(tmp_path / "f")).collect()) == [1, 3]
    with pytest.raises(ValueError):
        frame_tables.union_connections({})


def serial_split(segments):
    """The connection's segments one after another, as a receiver would do it."""
    frames, errors, buf, base, last = [], [], b"", None, None
    for number in sorted(segments):
        if last is not None and number != last + 1:
            if buf:
                errors.append("incomplete")
            buf = b""
        last = number
        buf += segments[number]
        at = 0
        while at + 2 <= len(buf):
            n = buf[at] | buf[at + 1] << 8
            if n < 24:
                errors.append("bad length")
                at = len(buf)
                break
            if at + n > len(buf):
                break
            frames.append(buf[at:at + n])
            at += n
        buf = buf[at:]
    if buf:
        errors.append("incomplete")
    return frames, sorted(errors)


def stored(root, segments):
    """Segment files; ``segments`` is connection -> number -> bytes."""
    for connection, parts in segments.items():
        os.makedirs(root / f"connection_id={connection}")
        for number, data in parts.items():
            (root / f"connection_id={connection}" / f"part-{number:05d}.cap").write_bytes(data)
    return str(root)


def capture_of(root, segment, damage):
    """A stored capture, and what a serial receiver makes of it."""
    rng = random.Random(segment + damage)
    segments, want_frames, want_errors = {}, {}, {}
    for connection in range(3):
        sizes = [rng.choice([0, 16, 88, 112, 128, 256, rng.randint(0, 3000), rng.randint(0, 65511)]) if segment > 100 else
                 rng.choice([0, 5, 16, 40]) for _ in range(60 if segment > 100 else 8)]
        stream = bytearray(b"".join(frame(i, rng.randbytes(n)) for i, n in enumerate(sizes)))
        for _ in range(damage):
            at = rng.randrange(len(stream) - 2)
            stream[at:at + 2] = b"\x05\x00"
        if connection == 2:
            stream += frame(9, b"x" * 50)[:rng.choice([1, 2, 30])]
        cuts = {i: bytes(stream[p:p + segment]) for i, p in enumerate(range(0, len(stream), segment))}
        if connection == 1 and segment >= 1000 and len(cuts) > 4:
            del cuts[2]
        if connection == 2:
            cuts[len(cuts)] = b""
        want_frames[connection], want_errors[connection] = serial_split(cuts)
        segments[connection] = cuts
    total = sum(len(d) for c in segments.values() for d in c.values())
    return stored(root, segments), want_frames, want_errors, total


def check_split(rows, want_frames, want_errors, total):
    frames = sorted((r for r in rows if r["problem"] is None), key=lambda r: r["recv_order"])
    problems = [r for r in rows if r["problem"] is not None]
    assert len({r["recv_order"] for r in frames}) == len(frames)
    for connection in range(3):
        assert [bytes(r["frame"]) for r in frames if r["connection_id"] == connection] == want_frames[connection]
        assert sorted(r["problem"] for r in problems if r["connection_id"] == connection) == want_errors[connection]
    # every byte is in a frame or left over
    assert sum(len(r["frame"]) for r in frames) + sum(r["left_over"] for r in problems) == total


@pytest.mark.parametrize("segment,damage,piece", [
    (1, 0, 1), (1, 0, 7), (7, 0, 5), (100, 0, 64), (1000, 2, 40_000), (5000, 3, 30_001), (70000, 2, 40_000), (70000, 0, 200_000),
    (300_000, 3, 50_000), (300_000, 3, 150_000), (300_000, 3, 1 << 20),
])
def test_ranges_equal_serial_receiver(tmp_path, segment, damage, piece):
    path, *want = capture_of(tmp_path / "c", segment, damage)
    rows, start = [], {}
    for one in capture.ranges_of(path, piece):
        one.start = 0 if one.fresh else start[one.connection_id]
        starts, exits = capture.range_map(one)
        start[one.connection_id] = exits[starts.index(one.start)]
        rows += [r for batch in capture.range_frames(one) for r in batch.to_pylist()]
    check_split(rows, *want)


@pytest.mark.parametrize("segment,damage,piece", [(7, 0, 60), (70000, 2, 50_000), (300_000, 3, 150_000)])
def test_capture_equals_serial_receiver(spark, tmp_path, segment, damage, piece):
    path, *want = capture_of(tmp_path / "c", segment, damage)
    split = capture.read_capture(spark, path, range_bytes=piece, run=4)
    assert capture.frames_of(split).columns == ["connection_id", "recv_order", "frame"]
    check_split(split.collect(), *want)
    assert capture.parse_errors(split).count() == sum(map(len, want[1].values()))


@pytest.mark.parametrize("seed", range(6))
def test_possible_starts_hold_every_walk(seed):
    rng = random.Random(seed)
    data = b"".join(frame(i, rng.randbytes(rng.choice([0, 30, 300, 3000]))) for i in range(300))
    data = bytearray(data[: rng.randrange(len(data) // 2, len(data))])
    for _ in range(seed):
        at = rng.randrange(len(data) - 1)
        data[at:at + 2] = b"\x01\x00"
    ends = sorted(rng.sample(range(1, len(data)), seed % 3))
    starts = capture.possible_starts(bytes(data), ends)
    for start in [*range(0, min(len(data), S.MAX_FRAME), 53), capture.DEAD]:
        assert capture.walk(bytes(data), ends, start, 0, len(data))[2] in starts


def test_parts_of_files_are_read_and_files_above_two_gigabytes(tmp_path, monkeypatch):
    body = b"".join(frame(i, bytes(200)) for i in range(2000))
    stored(tmp_path / "c", {4: {1: body, 2: b"", 3: body[:100]}, 9: {7: body}})
    ranges = capture.ranges_of(str(tmp_path / "c"), 100_000)
    assert max(sum(p.length for p in r.pieces) for r in ranges) == 100_000
    assert all(sum(p.length for p in r.before) <= capture.PEEK_BYTES for r in ranges)
    files = {0: [(1, "a", 5 << 30), (2, "b", 1 << 20)]}
    monkeypatch.setattr(capture, "segment_files", lambda path: files)
    ranges = capture.ranges_of("", 1 << 28)
    assert [r.pieces[0].offset for r in ranges][:20] == [i << 28 for i in range(20)] and len(ranges) == 21
    places = np.array([0, 30])
    segment, offset, order = capture._columns(places, [0], [ranges[19].pieces[0]])
    assert segment.tolist() == [1, 1] and offset.tolist() == [19 << 28, (19 << 28) + 30] and order.tolist() == [(19 << 28) // 24, ((19 << 28) + 30) // 24]


def test_missing_or_shrunk_files(spark, tmp_path):
    assert capture.ranges_of(stored(tmp_path / "none", {})) == [] if os.makedirs(tmp_path / "none") is None else False
    path = stored(tmp_path / "c", {0: {1: frame(1, b"abc") * 10}})
    (one,) = capture.ranges_of(path)
    (tmp_path / "c" / "connection_id=0" / "part-00001.cap").write_bytes(b"short")
    with pytest.raises(OSError, match="shorter"):
        list(capture.range_frames(one))
    twice = stored(tmp_path / "t", {0: {1: b"x"}})
    (tmp_path / "t" / "connection_id=0" / "other-1.cap").write_bytes(b"y")
    with pytest.raises(ValueError, match="one segment number"):
        capture.ranges_of(twice)


def test_resume_opens_only_files_past_the_point(spark, tmp_path):
    path = str(tmp_path / "f")
    for at in range(4):
        rows = [(c, 100 * at + i, bytearray(frame(100 * at + i))) for c in (1, 2) for i in range(10)]
        part = spark.createDataFrame(rows, FRAME).coalesce(1)
        part.write.mode("append").partitionBy("connection_id").parquet(path)
    table = frame_tables.read_frames(spark, path)
    index = frame_tables.file_index(table).persist()
    assert index.count() == 8
    points = spark.createDataFrame([(1, 205), (2, 399)], "connection_id long, last_seq long")
    files = frame_tables.resume_files(index, points)
    assert len(files) == 2 and all("connection_id=1" in f for f in files)
    left = frame_tables.resume_frames(spark, path, index, points)
    assert sorted(left.inputFiles()) == files
    assert sorted((r.connection_id, int(r.resp_seq)) for r in left.collect()) == [(1, s) for s in [*range(206, 210), *range(300, 310)]]
    none = spark.createDataFrame([(2, 10**6)], "connection_id long, last_seq long")
    assert {f.split("connection_id=")[1][0] for f in frame_tables.resume_files(index, none)} == {"1"}
    both = spark.createDataFrame([(1, 10**6), (2, 10**6)], "connection_id long, last_seq long")
    assert frame_tables.resume_frames(spark, path, index, both).count() == 0


def test_listed_files_keep_their_store():
    assert capture.full_path("/data/c", "/data/c/connection_id=1/a1.cap") == "/data/c/connection_id=1/a1.cap"
    assert capture.full_path("file:///data/c", "/data/c/x") == "/data/c/x"
    assert capture.full_path("hdfs://host:9000/c", "/c/x") == "hdfs://host:9000/c/x"
    assert capture.full_path("s3a://bucket/c", "bucket/c/x") == "s3a://bucket/c/x"
