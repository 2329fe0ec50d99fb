"""Writing the wire format: rows to frames. Used to build captures and test inputs out of tables.

The layouts become numpy structured types, so a batch of rows of one message type is encoded column by column.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.functions.layouts import HEAD, frame_dtype
from tickloom.operators import prefix
from tickloom.sources.capture import filesystem_of

_OTHER = S.Layout("other", (), S.BODY_HEAD_BYTES, ())


def encode(messages: DataFrame) -> DataFrame:
    """``(connection_id, recv_order, frame)`` of messages that carry a column for each field of their type's layout.

    Needs ``connection_id, recv_order, resp_seq, msg_seq_num, hdr_ts, flags, msg_type, ts_ns``; types without a layout get a
    body that is only the body head.
    """
    return messages.mapInArrow(_encode_batches, S.FRAME_SCHEMA)


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {n: c for n, c in zip(batch.schema.names, batch.columns)}
        kinds = cols["msg_type"].to_numpy(zero_copy_only=False)
        for code in np.unique(kinds):
            rows = pa.array(np.flatnonzero(kinds == code))
            layout = S.LAYOUT_BY_CODE.get(int(code), _OTHER)
            out = np.zeros(len(rows), frame_dtype(layout))
            out["resp_len"] = out.dtype.itemsize
            for name, _, _ in HEAD[1:]:
                source = "msg_seq_num" if name == "body_seq" else name
                out[name] = cols[source].take(rows).to_numpy(zero_copy_only=False)
            for x in layout.fields:
                values = cols[x.name].take(rows).to_numpy(zero_copy_only=False)
                out[f"b_{x.name}"] = np.char.encode(values.astype(f"U{x.width}"), "latin-1") if x.kind == "char" else values
            size = out.dtype.itemsize
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [cols["connection_id"].take(rows), cols["recv_order"].take(rows), fixed.cast(pa.binary())],
                names=["connection_id", "recv_order", "frame"],
            )


def wire_fields(feed: DataFrame) -> DataFrame:
    """Feed rows with a value for every field of every layout; what the feed lacks is derived from what it has."""
    q, seq = F.col("quantity"), F.col("msg_seq_num")
    side = F.when(q % 2 == 0, "B").otherwise("S")
    return feed.withColumns({
        "resp_seq": seq,
        "hdr_ts": F.call_function("div", F.col("ts_ns"), F.lit(1_000_000_000)),
        "flags": (F.col("recv_order") % 7).cast("int"),
        "order_id": F.col("recv_order") + 1,
        "side": side,
        "order_type": F.when(q % 3 == 0, "M").otherwise("L"),
        "new_price": F.col("price"),
        "new_quantity": q,
        "old_quantity": q + 1,
        "cancelled_qty": q,
        "cancel_reason": F.when(q % 5 == 0, "S").otherwise("U"),
        "trade_id": F.col("recv_order") + 1,
        "bid_order_id": F.col("recv_order") * 2,
        "ask_order_id": F.col("recv_order") * 2 + 1,
        "aggressor_side": side,
        "trade_condition": F.lit("R"),
        "num_orders": F.call_function("div", q, F.lit(2)),
    })


def segment_pieces(frames: DataFrame, segment_bytes: int, chunk: int = prefix.CHUNK) -> DataFrame:
    """``connection_id, segment_no, at, data``: the frames cut into segments of a fixed size, without regard to their borders.

    The byte position of a frame is the running length of its connection; a frame across a border gives a piece to each segment.
    """
    sized = frames.withColumn("_len", F.length("frame").cast("bigint"))
    placed = prefix.running(sized, ["connection_id"], "recv_order", {"_end": ("sum", "_len")}, chunk=chunk)
    placed = placed.withColumn("_at", F.col("_end") - F.col("_len"))
    number = lambda position: F.call_function("div", position, F.lit(segment_bytes))
    cut = placed.withColumn("segment_no", F.explode(F.sequence(number(F.col("_at")), number(F.col("_end") - 1))))
    start = F.greatest(F.col("segment_no") * segment_bytes, F.col("_at"))
    stop = F.least((F.col("segment_no") + 1) * segment_bytes, F.col("_end"))
    piece = F.substr("frame", (start - F.col("_at") + 1).cast("int"), (stop - start).cast("int"))
    return cut.select("connection_id", "segment_no", start.alias("at"), piece.alias("data"))


def store_segments(pieces: DataFrame, path: str) -> int:
    """Write ``connection_id, segment_no, at, data`` as segment files below ``path`` and give their number.

    A task writes its segments one after another from sorted pieces, each under a name of its own that is then moved into place, so a
    repeated task replaces what it wrote.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem_of(path)
        key, out, name, written = None, None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                files.move(f"{name}.{os.getpid()}", name)

        for batch in batches:
            for connection, number, data in zip(*(batch.column(i) for i in (0, 1, 3))):
                if (connection.as_py(), number.as_py()) != key:
                    close()
                    key = (connection.as_py(), number.as_py())
                    files.create_dir(f"{root}/connection_id={key[0]}")
                    name = f"{root}/connection_id={key[0]}/segment-{key[1]:08d}.cap"
                    out = files.open_output_stream(f"{name}.{os.getpid()}")
                    written += 1
                out.write(data.as_buffer())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["written"])

    dealt = pieces.repartition("connection_id", "segment_no").sortWithinPartitions("connection_id", "segment_no", "at")
    return dealt.mapInArrow(write, "written bigint").agg(F.sum("written")).first()[0] or 0
