"""Raw captures to frames, as a Spark data source that reads ranges of files.

A capture is the byte stream of a connection, stored as numbered segment files ``<path>/connection_id=<id>/<anything><number>.<ext>``
that may be cut anywhere and be of any size. The stream is dealt out in ranges of some megabytes. Where the first frame of a range
starts depends on all bytes before it; that is found without moving any content:

1. ``maps``: the task of a range also reads the 128 KB before it and walks them from every place a frame could start. The walks run
   into each other, so a few starts are left, and the range is walked from these only. Its map has one row per start.
2. The maps, some bytes per range, are chained along each connection, in runs and then from run to run.
3. ``frames``: with its true start known, each range yields the frames that begin in it, reading on past its end for the last one.

Each byte is read twice, and contents are neither shuffled nor joined nor held beyond a range and what is read around it.

Rules: a frame length below 24 is a parse error and drops the rest of the segment in which the length ends, the next segment starts
afresh; a frame still open at the end of the capture is reported as incomplete; after a missing segment number all starts afresh.

Files are read through ``pyarrow.fs`` (local or shared folders, hdfs, s3, gs and what else it knows).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tickloom import schema as S
from tickloom import session

RANGE_BYTES = 32 << 20
PEEK_BYTES = 1 << 17  # more than the longest frame, so that no frame reaches over it
RUN = 4096  # ranges chained in one task
ROWS = 1 << 16  # frames in a batch
DEAD = -2  # a start: the rest of the segment is dropped

_MAP = "connection_id bigint, range_no bigint, fresh boolean, starts array<int>, exits array<int>"
_FRAMES = (
    "connection_id bigint, segment_no bigint, frame_offset bigint, recv_order bigint, problem string, left_over bigint, frame binary"
)


@dataclass(frozen=True)
class Piece:
    """Bytes of one segment file. ``order`` is the arrival order of the segment's first byte."""

    path: str
    offset: int
    length: int
    segment_no: int
    size: int
    order: int

    @property
    def ends_segment(self) -> bool:
        return self.offset + self.length == self.size


@dataclass
class Range(InputPartition):
    """Consecutive pieces of a connection, with what stands before and after them; ``fresh`` if nothing comes before."""

    connection_id: int
    range_no: int
    pieces: list[Piece]
    fresh: bool
    before: list[Piece] = field(default_factory=list)
    before_fresh: bool = False
    after: list[Piece] = field(default_factory=list)
    start: int = 0


# --- ranges of files -------------------------------------------------------------------------------------------------


def filesystem_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    path = re.sub(r"^s3[an]://", "s3://", path)
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def full_path(root: str, listed: str) -> str:
    """A listed file's path with the scheme it was listed by; object stores list the bucket as the first folder."""
    scheme = re.match(r"^([a-z0-9]+)://[^/]*", root)
    if not scheme or scheme.group(1) == "file":
        return listed
    return scheme.group() + listed if listed.startswith("/") else f"{scheme.group(1)}://{listed}"


def segment_files(path: str) -> dict[int, list[tuple[int, str, int]]]:
    """``connection -> [(segment number, file, size)]`` in order. Only names and sizes are listed, as for any table of files."""
    files, root = filesystem_of(path)
    found: dict[int, list] = {}
    for info in files.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)):
        named = re.search(r"connection_id=(\d+)/(?:[^/]*?)(\d+)\.[^./]*$", info.path)
        if info.type == pyarrow.fs.FileType.File and named:
            found.setdefault(int(named.group(1)), []).append((int(named.group(2)), full_path(path, info.path), info.size))
    for connection, segments in found.items():
        segments.sort()
        if len({n for n, _, _ in segments}) < len(segments):
            raise ValueError(f"connection {connection} has two files with one segment number")
    return found


def _orders(found: dict[int, list[tuple[int, str, int]]]) -> dict[tuple[int, int], int]:
    """Arrival order of each segment's start. Frames are 24 bytes or longer, so every 24 bytes have a number of their own."""
    orders, at = {}, 0
    for segment_no, connection, size in sorted((n, c, size) for c, segments in found.items() for n, _, size in segments):
        orders[connection, segment_no] = at
        at += -(-size // S.MIN_FRAME)
    return orders


def _stretches(segments: list[tuple[int, str, int]]) -> Iterator[list[tuple[int, str, int]]]:
    """Segments between missing numbers."""
    part: list[tuple[int, str, int]] = []
    for one in segments:
        if part and one[0] != part[-1][0] + 1:
            yield part
            part = []
        part.append(one)
    if part:
        yield part


def ranges_of(path: str, range_bytes: int = RANGE_BYTES) -> list[Range]:
    """All ranges of a capture."""
    found = segment_files(path)
    orders, ranges = _orders(found), []
    for connection, segments in sorted(found.items()):
        number = 0
        for stretch in _stretches(segments):
            groups, room = [[]], range_bytes
            for segment_no, file, size in stretch:
                at = 0
                while at < size or size == 0:
                    length = min(size - at, room)
                    groups[-1].append(Piece(file, at, length, segment_no, size, orders[connection, segment_no]))
                    at, room = at + length, room - length
                    if room == 0:
                        groups.append([])
                        room = range_bytes
                    if size == 0:
                        break
            groups = [g for g in groups if g]
            for i, group in enumerate(groups):
                before, whole = _around((groups[j] for j in range(i - 1, -1, -1)), PEEK_BYTES, last=True)
                after, _ = _around((groups[j] for j in range(i + 1, len(groups))), S.MAX_FRAME + 1, last=False)
                ranges.append(Range(connection, number, group, i == 0, before, whole, after))
                number += 1
    return ranges


def _around(groups: Iterable[list[Piece]], need: int, last: bool) -> tuple[list[Piece], bool]:
    """Pieces with the ``need`` nearest bytes of ``groups`` (nearest group first), in order, and whether these are all there are."""
    taken: list[Piece] = []
    for group in groups:
        for piece in reversed(group) if last else group:
            if need <= 0:
                return (taken[::-1] if last else taken), False
            length = min(piece.length, need)
            offset = piece.offset + piece.length - length if last else piece.offset
            taken.append(Piece(piece.path, offset, length, piece.segment_no, piece.size, piece.order))
            need -= length
            if length < piece.length:
                return (taken[::-1] if last else taken), False
    return (taken[::-1] if last else taken), True


def _read(pieces: list[Piece]) -> bytes:
    parts = []
    for piece in pieces:
        if piece.length:
            files, path = filesystem_of(piece.path)
            with files.open_input_file(path) as file:
                parts.append(file.read_at(piece.length, piece.offset))
                if len(parts[-1]) != piece.length:
                    raise OSError(f"{piece.path} is shorter than when it was listed")
    return b"".join(parts) if len(parts) != 1 else parts[0]


def _segment_ends(pieces: list[Piece]) -> list[int]:
    """Places where a segment ends, as bytes from the start of ``pieces``."""
    ends, at = [], 0
    for piece in pieces:
        at += piece.length
        if piece.ends_segment and (not ends or ends[-1] != at):
            ends.append(at)
    return ends


# --- walks -----------------------------------------------------------------------------------------------------------


def possible_starts(data: bytes, ends: list[int]) -> set[int]:
    """Where a frame can start after ``data``, from its end on, if one could start in it anywhere; found from the back."""
    size = len(data)
    lengths = np.frombuffer(data[: size - 1], np.uint8).astype(np.int64) | np.frombuffer(data[1:], np.uint8).astype(np.int64) << 8
    lengths = lengths.tolist()
    exits = [-1] * size  # a start at the last byte: its length ends in the next range
    for at in range(size - 2, -1, -1):
        length = lengths[at]
        if length < S.MIN_FRAME:
            k = bisect_right(ends, at + 1)
            after = ends[k] if k < len(ends) else None
            exits[at] = DEAD if after is None else 0 if after == size else exits[after]
        else:
            exits[at] = exits[at + length] if at + length < size else at + length - size
    found = set(exits[: min(size, S.MAX_FRAME)])
    if not ends:
        found.add(DEAD)
    else:  # what was dropped before ends with the segment
        found.add(0 if ends[0] == size else exits[ends[0]])
    return found


def walk(data: bytes, ends: list[int], start: int, first: int, stop: int, seen: dict[int, int] | None = None) -> tuple[list[int], list, int]:
    """Frames of ``data`` that start from ``start`` on and before ``stop``.

    Gives their places, the errors as (start, end of what is dropped or None if that lies beyond ``stop``), and the start after
    ``stop``, counted from it. ``first`` is where the range begins in ``data``; ``DEAD`` drops what is left of its segment. With
    ``seen`` the walk ends where an earlier one passed, and takes its exit.
    """
    places, errors = [], []
    if start == DEAD:
        k = bisect_right(ends, first)
        if k == len(ends) or ends[k] > stop:
            return places, errors, DEAD
        at = ends[k]
    else:
        at = first + start
    # A frame of which only the first byte stands in the range is the next one's, as its length ends there.
    while at < stop - 1:
        if seen is not None and at in seen:
            return places, errors, seen[at]
        length = data[at] | data[at + 1] << 8
        if length < S.MIN_FRAME:
            k = bisect_right(ends, at + 1)
            after = ends[k] if k < len(ends) and ends[k] <= stop else None
            errors.append((at, after))
            if after is None:
                return places, errors, DEAD
            at = after
            continue
        places.append(at)
        at += length
    return places, errors, at - stop


def range_map(one: Range) -> tuple[list[int], list[int]]:
    """Possible starts of a range and the exit each of them leads to."""
    before, own = _read(one.before), _read(one.pieces)
    if one.fresh:
        starts = {0}
    elif one.before_fresh:
        starts = {walk(before, _segment_ends(one.before), 0, 0, len(before))[2]}
    else:
        starts = possible_starts(before, _segment_ends(one.before))
    # The byte before the range is there for a frame that starts with it.
    data, first = before[-1:] + own, len(before[-1:])
    ends = [first + e for e in _segment_ends(one.pieces)]
    seen: dict[int, int] = {}
    exits = []
    for start in sorted(starts):
        places, _, exit_ = walk(data, ends, start, first, len(data), seen)
        seen.update(dict.fromkeys(places, exit_))
        exits.append(exit_)
    return sorted(starts), exits


def range_frames(one: Range) -> Iterator[pa.RecordBatch]:
    """Frames and problems that start in a range."""
    before = _last_byte(one.before)
    own, after = _read(one.pieces), _read(one.after)
    data, first = before + own + after, len(before)
    stop = first + len(own)
    ends = [first + e for e in _segment_ends(one.pieces + one.after)]
    # Ends beyond the range's own bytes are needed for nothing but what is dropped across its border.
    places, errors, exit_ = walk(data, ends, one.start, first, stop)
    at_piece, pieces = _locate(one, before, first)
    whole, cut = [], []
    for place in places:
        length = data[place] | data[place + 1] << 8
        (whole if place + length <= len(data) else cut).append(place)
    view = np.frombuffer(data, np.uint8)
    for lo in range(0, len(whole), ROWS):
        part = np.array(whole[lo : lo + ROWS], np.int64)
        lengths = view[part].astype(np.int64) | view[part + 1].astype(np.int64) << 8
        yield _frame_rows(one.connection_id, part, lengths, data, at_piece, pieces)
    left = [(place, "incomplete", len(data) - place) for place in cut]
    for place, after_it in errors:
        left.append((place, "bad length", _dropped(place, after_it, at_piece, pieces)))
    if exit_ == -1 and not one.after:
        left.append((stop - 1, "incomplete", 1))
    if left:
        left.sort()
        yield _problem_rows(one.connection_id, left, at_piece, pieces)


def _last_byte(pieces: list[Piece]) -> bytes:
    for piece in reversed(pieces):
        if piece.length:
            return _read([Piece(piece.path, piece.offset + piece.length - 1, 1, piece.segment_no, piece.size, piece.order)])
    return b""


def _locate(one: Range, before: bytes, first: int) -> tuple[list[int], list[Piece]]:
    """Where pieces start in the data that is read, and the pieces."""
    starts, pieces, at = [], [], 0
    if before:
        last = next(p for p in reversed(one.before) if p.length)
        starts.append(0)
        pieces.append(Piece(last.path, last.offset + last.length - 1, 1, last.segment_no, last.size, last.order))
    at = first
    for piece in one.pieces + one.after:
        if piece.length:
            starts.append(at)
            pieces.append(piece)
            at += piece.length
    return starts, pieces


def _dropped(place: int, after_it: int | None, at_piece: list[int], pieces: list[Piece]) -> int:
    """Bytes from a bad frame to the end of the segment its length ends in."""
    if after_it is not None:
        return after_it - place
    k = bisect_right(at_piece, place + 1) - 1
    ends_in = pieces[k]
    return at_piece[k] + ends_in.size - ends_in.offset - place


def _columns(places: np.ndarray, at_piece: list[int], pieces: list[Piece]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = np.searchsorted(np.array(at_piece), places, side="right") - 1
    offsets = places - np.array(at_piece)[k] + np.array([p.offset for p in pieces])[k]
    return np.array([p.segment_no for p in pieces])[k], offsets, np.array([p.order for p in pieces])[k] + offsets // S.MIN_FRAME


def _frame_rows(connection: int, places: np.ndarray, lengths: np.ndarray, data: bytes, at_piece, pieces) -> pa.RecordBatch:
    segment, offset, order = _columns(places, at_piece, pieces)
    n = len(places)
    if np.array_equal(places[1:], places[:-1] + lengths[:-1]):  # back to back: the frames are a view of the data
        borders = np.append(places, places[-1] + lengths[-1]).astype(np.int32)
        frames = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(borders.tobytes()), pa.py_buffer(data)])
    else:
        frames = pa.array([data[p : p + k] for p, k in zip(places.tolist(), lengths.tolist())], pa.binary())
    return _batch(connection, segment, offset, order, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), frames)


def _problem_rows(connection: int, left: list[tuple[int, str, int]], at_piece, pieces) -> pa.RecordBatch:
    segment, offset, order = _columns(np.array([p for p, _, _ in left], np.int64), at_piece, pieces)
    kinds, sizes = pa.array([k for _, k, _ in left]), pa.array([n for _, _, n in left], pa.int64())
    return _batch(connection, segment, offset, order, kinds, sizes, pa.nulls(len(left), pa.binary()))


def _batch(connection, segment, offset, order, problem, left_over, frame) -> pa.RecordBatch:
    columns = [
        pa.array(np.full(len(problem), connection), pa.int64()), pa.array(segment, pa.int64()), pa.array(offset, pa.int64()),
        pa.array(order, pa.int64()), problem, left_over, frame,
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _FRAMES.split(", ")])


# --- the data source -------------------------------------------------------------------------------------------------


class CaptureSource(DataSource):
    """``read.format("tickloom_capture").load(path)`` with ``kind`` ``maps`` or ``frames``; the latter needs ``starts``, a stored table."""

    @classmethod
    def name(cls) -> str:
        return "tickloom_capture"

    def schema(self) -> str:
        return _MAP if self.options.get("kind") == "maps" else _FRAMES

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(dict(self.options))


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {name.lower(): value for name, value in options.items()}

    def partitions(self) -> list[Range]:
        ranges = ranges_of(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))
        if self.options.get("kind") != "maps" and "starts" in self.options:
            # One row of a few bytes per range, as the list of ranges itself.
            files, root = filesystem_of(self.options["starts"])
            table = pyarrow.parquet.read_table(root, filesystem=files, columns=["connection_id", "range_no", "start"])
            known = {(c, n): s for c, n, s in zip(*(table.column(i).to_pylist() for i in range(3)))}
            for one in ranges:
                one.start = known[one.connection_id, one.range_no]
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if self.options.get("kind") != "maps":
            yield from range_frames(partition)
            return
        starts, exits = range_map(partition)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([partition.connection_id], pa.int64()), pa.array([partition.range_no], pa.int64()), pa.array([partition.fresh]),
                pa.array([starts], pa.list_(pa.int32())), pa.array([exits], pa.list_(pa.int32())),
            ],
            [c.split()[0] for c in _MAP.split(", ")],
        )


def _chain(frame: pd.DataFrame, states: dict[int, int]) -> Iterator[tuple[int, dict[int, int]]]:
    """States before each range in order, from what they were before the first."""
    for row in frame.sort_values("range_no").itertuples(index=False):
        if row.fresh:
            states = dict.fromkeys(states, 0)
        yield row.range_no, states
        exits = dict(zip(row.starts.tolist(), row.exits.tolist()))
        states = {origin: exits[state] for origin, state in states.items()}
    yield -1, states


def _composed(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for a run of ranges: from the possible starts of its first to the exits of its last."""
    first = frame.loc[frame["range_no"].idxmin()]
    *_, (_, states) = _chain(frame, {s: s for s in first.starts.tolist()})
    row = (first.connection_id, first.range_no, first.fresh, list(states), list(states.values()))
    return pd.DataFrame([row], columns=["connection_id", "range_no", "fresh", "starts", "exits"])


def _started(frame: pd.DataFrame) -> pd.DataFrame:
    """The true start of each range or run, from that of the first (0 where a connection begins)."""
    start = int(frame.loc[frame["range_no"].idxmin()].start) if "start" in frame else 0
    rows = [(n, states[start]) for n, states in _chain(frame, {start: start}) if n >= 0]
    out = pd.DataFrame(rows, columns=["range_no", "start"])
    out.insert(0, "connection_id", frame["connection_id"].iloc[0])
    return out


def range_starts(maps: DataFrame, run: int = RUN) -> DataFrame:
    """``connection_id, range_no, start`` of every range."""
    numbered = session.materialize(maps.withColumn("run", F.call_function("div", F.col("range_no"), F.lit(run))))
    started = "connection_id bigint, range_no bigint, start int"
    runs = numbered.groupBy("connection_id", "run").applyInPandas(_composed, _MAP)
    firsts = runs.groupBy("connection_id").applyInPandas(_started, started)
    firsts = firsts.select("connection_id", F.call_function("div", F.col("range_no"), F.lit(run)).alias("run"), "start")
    return numbered.join(firsts, ["connection_id", "run"]).groupBy("connection_id", "run").applyInPandas(_started, started)


def read_capture(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, run: int = RUN) -> DataFrame:
    """Frames and problems of all segments below ``path``.

    ``connection_id, segment_no, frame_offset, recv_order, problem, left_over, frame``: ``problem`` is NULL for a frame and ``bad length``
    or ``incomplete`` otherwise, with the bytes ``left_over``. A frame counts where it starts. ``recv_order`` follows segment number,
    connection and offset. Files must not change between the two readings; a shorter one is an error.
    """
    session.ship_package(spark)
    spark.dataSource.register(CaptureSource)
    reader = spark.read.format(CaptureSource.name()).option("rangebytes", range_bytes)
    starts = session.scratch_path(spark, "capture-starts")
    range_starts(reader.option("kind", "maps").load(path), run).write.parquet(starts)
    return reader.option("kind", "frames").option("starts", starts).load(path)


def frames_of(capture: DataFrame) -> DataFrame:
    """The frames of a capture as a frame table."""
    return capture.filter("problem is null").select("connection_id", "recv_order", "frame")


def parse_errors(capture: DataFrame) -> DataFrame:
    """Bad lengths and incomplete frames, with the bytes left over."""
    return capture.filter("problem is not null").select("connection_id", "segment_no", "frame_offset", "problem", "left_over")
