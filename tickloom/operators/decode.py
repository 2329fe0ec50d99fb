"""Frames to typed messages.

Frames of the wanted types are picked by one byte before anything leaves the JVM. A batch of them is then read column by column: the
frames lie back to back in the Arrow buffer, so one numpy structured type per layout gives every field of all of them at once.
Nothing shuffles, and rows keep their order and their other columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schema as S
from tickloom.functions import binary
from tickloom.functions.layouts import HEAD, frame_dtype, frames_view, texts, u63, u64
from tickloom.functions.tags import enum_label

_KINDS = {"char": T.StringType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "f64": T.DoubleType()}
_CODE = np.dtype({"names": ["t"], "formats": ["u1"], "offsets": [S.HEAD_BYTES + S.BODY_TYPE_AT], "itemsize": S.HEAD_BYTES + S.BODY_TYPE_AT + 1})


def _in_body(offset: int) -> int:
    return S.HEAD_BYTES + offset


def frame_length_ok(frame: Column) -> Column:
    return F.length(frame).between(S.MIN_FRAME, S.MAX_FRAME)


def message_type() -> Column:
    """First body byte; 0 (unknown) for a body shorter than its head or a code past the last known one."""
    code = binary.u8("frame", _in_body(S.BODY_TYPE_AT))
    short = F.length("frame") < _in_body(S.BODY_HEAD_BYTES)
    return F.when(short | (code > S.INSTRUMENT_REF), S.UNKNOWN).otherwise(code)


def body_size_ok(msg_type: Column, frame: Column) -> Column:
    """Whether the body has at least the size of its type's layout (types without a layout: always)."""
    need = F.lit(0)
    for code, layout in S.LAYOUT_BY_CODE.items():
        need = F.when(msg_type == code, layout.size).otherwise(need)
    return F.length(frame) - S.HEAD_BYTES >= need


def _of_layout(layout: S.Layout) -> Column:
    """Whether a frame has one of the layout's codes and at least its size; compares bytes, decodes nothing."""
    code = F.substring("frame", _in_body(S.BODY_TYPE_AT) + 1, 1)
    codes = [F.lit(bytes([c])) for c in layout.codes]
    return code.isin(*codes) & (F.length("frame") >= _in_body(layout.size)) & (F.length("frame") <= S.MAX_FRAME)


def _mapped(frames: DataFrame, fields: list[T.StructField], decode: Callable[[pa.Array], list[pa.Array]], keep: Sequence[str]) -> DataFrame:
    """``keep`` of the frame table's columns, then ``fields`` made of the frames by ``decode``, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(i) for i in range(len(keep))]
            made = decode(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays(kept + made, [*keep, *names])

    names = [f.name for f in fields]
    given = [frames.schema[c] for c in keep]
    # The frame comes last, so that a frame table with two columns of one name is still told apart.
    return frames.select(*keep, F.col("frame").alias("_frame")).mapInArrow(run, T.StructType(given + fields))


def decode_heads(frames: DataFrame, contents: bool = True) -> DataFrame:
    """Envelope, message header, body and message type of every frame of legal length.

    Without ``contents`` the frame and its body are left out.
    """
    fields = [
        T.StructField("resp_len", T.IntegerType()), T.StructField("resp_seq", T.DecimalType(20, 0)),
        T.StructField("msg_seq_num", T.DecimalType(20, 0)), T.StructField("hdr_ts", T.LongType()), T.StructField("flags", T.IntegerType()),
        T.StructField("body_len", T.IntegerType()), T.StructField("msg_type", T.IntegerType()),
    ]
    dtype = frame_dtype(S.Layout("head", (), 0, ()), HEAD[:5])

    def decode(array: pa.Array) -> list[pa.Array]:
        view, lengths = frames_view(array, dtype)
        bodies = lengths - S.HEAD_BYTES
        kinds = np.zeros(len(view), np.int32)
        long = bodies >= S.BODY_HEAD_BYTES
        kinds[long] = frames_view(array, _CODE, long)[0]["t"]
        kinds[kinds > S.INSTRUMENT_REF] = S.UNKNOWN
        return [
            pa.array(view["resp_len"].astype(np.int32)), u64(view["resp_seq"]), u64(view["msg_seq_num"]), pa.array(view["hdr_ts"].astype(np.int64)),
            pa.array(view["flags"].astype(np.int32)), pa.array(bodies.astype(np.int32)), pa.array(kinds),
        ]

    legal, f = frames.filter(frame_length_ok(F.col("frame"))), F.col("frame")
    if not contents:
        return _mapped(legal, fields, decode, [c for c in frames.columns if c != "frame"])
    heads = _mapped(legal, fields, decode, frames.columns)
    return heads.withColumn("body", F.substring(f, S.HEAD_BYTES + 1, S.MAX_FRAME))


def typed(frames: DataFrame, layout_name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All fields of one layout, or the named ``columns`` of them; other types and short bodies are left out."""
    layout = S.LAYOUTS[layout_name]
    fields = [
        T.StructField("resp_seq", T.DecimalType(20, 0)), T.StructField("msg_seq_num", T.DecimalType(20, 0)),
        T.StructField("msg_type", T.IntegerType()), T.StructField("body_seq", T.LongType()), T.StructField("ts_ns", T.LongType()),
        *[T.StructField(x.name, _KINDS[x.kind]) for x in layout.fields],
    ]
    fields = [f for f in fields if columns is None or f.name in columns]
    kinds = {x.name: x.kind for x in layout.fields} | {"resp_seq": "u64", "msg_seq_num": "u64", "msg_type": "code", "body_seq": "u32", "ts_ns": "u63"}
    dtype = frame_dtype(layout)
    wanted = [(f.name, kinds[f.name]) for f in fields]

    def decode(array: pa.Array) -> list[pa.Array]:
        view, _ = frames_view(array, dtype)
        return [_column(view, name, kind) for name, kind in wanted]

    return _mapped(frames.filter(_of_layout(layout)), fields, decode, [c for c in frames.columns if c != "frame"])


def _column(view: np.ndarray, name: str, kind: str) -> pa.Array:
    values = view[name if name in view.dtype.names else f"b_{name}"]
    if kind == "char":
        return texts(values)
    if kind == "u64":
        return u64(values)
    if kind == "u63":
        return u63(values)
    return pa.array(np.ascontiguousarray(values).astype({"u32": np.int64, "code": np.int32, "f64": np.float64}[kind], copy=False))


# The field that plays a part in the metrics, per message type.
_PRICE = {"order_new": "price", "order_update": "new_price", "trade": "price", "quote": "price"}
_QUANTITY = {
    "order_new": "quantity", "order_update": "new_quantity", "order_cancel": "cancelled_qty", "trade": "quantity",
    "quote": "quantity",
}
_BROKER = ("order_new", "order_update", "order_cancel")


def decode_feed(frames: DataFrame, measurements: Sequence[str] = tuple(S.MEASUREMENTS)) -> DataFrame:
    """All typed messages in the one shape the metrics work on (``price`` and ``quantity`` as each type defines them).

    ``measurements`` may leave out types that are not needed before anything is decoded.
    """
    codes = [c for m in measurements for c in S.MEASUREMENTS[m]]
    layouts = [layout for layout in S.LAYOUTS.values() if set(layout.codes) & set(codes)]
    wanted = F.substring("frame", _in_body(S.BODY_TYPE_AT) + 1, 1).isin(*[F.lit(bytes([c])) for c in codes])
    fits = F.lit(False)
    for layout in layouts:
        fits = fits | _of_layout(layout)
    fields = [f for f in S.FEED_SCHEMA.fields if f.name not in ("recv_order", "connection_id")]
    fields[0] = T.StructField("msg_seq_num", T.DecimalType(20, 0))
    dtypes = {layout.name: frame_dtype(layout) for layout in layouts}

    def decode(array: pa.Array) -> list[pa.Array]:
        n = len(array)
        kinds = frames_view(array, _CODE)[0]["t"]
        seq, ts = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        market, instrument, broker = np.zeros(n, "S16"), np.zeros(n, "S32"), np.zeros(n, "S32")
        price, quantity = np.zeros(n), np.zeros(n, np.int64)
        no_price, no_broker = np.ones(n, bool), np.ones(n, bool)
        for layout in layouts:
            at = np.isin(kinds, layout.codes)
            if not at.any():
                continue
            view, _ = frames_view(array, dtypes[layout.name], at)
            seq[at], ts[at] = view["msg_seq_num"], view["ts_ns"]
            market[at], instrument[at] = view["b_market"], view["b_instrument"]
            quantity[at] = view[f"b_{_QUANTITY[layout.name]}"]
            if layout.name in _PRICE:
                price[at], no_price[at] = view[f"b_{_PRICE[layout.name]}"], False
            if layout.name in _BROKER:
                broker[at], no_broker[at] = view["b_broker"], False
        return [
            u64(seq), u63(ts), pa.array(kinds.astype(np.int32)), texts(market), texts(instrument), texts(broker, no_broker),
            pa.array(price, mask=no_price), pa.array(quantity),
        ]

    return _mapped(frames.filter(wanted & fits), fields, decode, ["recv_order", "connection_id"])


def frame_rejects(frames: DataFrame) -> DataFrame:
    """Frames no typed message comes from, with the reason.

    ``length`` counts as a parse error; ``short body`` (smaller than its type's layout) is skipped by the metrics, and so is
    ``timestamp`` (not below 2**63).
    """
    f, kind = F.col("frame"), message_type()
    typed_kind = kind.between(S.ORDER_NEW, S.QUOTE_ASK)
    last_of_time = F.substring(f, _in_body(S.BODY_TS_AT) + 8, 1)
    reason = (
        F.when(~frame_length_ok(f), "length")
        .when(typed_kind & ~body_size_ok(kind, f), "short body")
        .when(typed_kind & (last_of_time >= F.lit(b"\x80")), "timestamp")
    )
    return frames.select("connection_id", "recv_order", F.length(f).alias("frame_len"), reason.alias("reason")).filter(
        "reason is not null"
    )


def type_label(code: Column) -> Column:
    return enum_label(code, S.TYPE_NAMES, "MarketDataType")
