"""Wire layouts, message types and record schemas of a market feed.

Every value in the "fixed values" blocks is part of the wire format or of the metric naming scheme and has to be exactly
as it is; everything else in the library is derived from these tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------------------------------
# Message type codes
# ---------------------------------------------------------------------------------------------------------------------
UNKNOWN = 0
ORDER_NEW = 1
ORDER_UPDATE = 2
ORDER_CANCEL = 3
TRADE = 4
QUOTE_BID = 5
QUOTE_ASK = 6
INSTRUMENT_REF = 7

TYPE_NAMES = {
    0: "UNKNOWN",
    1: "ORDER_NEW",
    2: "ORDER_UPDATE",
    3: "ORDER_CANCEL",
    4: "TRADE",
    5: "QUOTE_BID",
    6: "QUOTE_ASK",
    7: "INSTRUMENT_REF",
}

# ---------------------------------------------------------------------------------------------------------------------
# Frame head (packed, little endian, offsets from the first byte of the frame) and legal frame lengths
# ---------------------------------------------------------------------------------------------------------------------
RESP_LEN_AT = 0  # u16, length of the whole frame
RESP_SEQ_AT = 2  # u64
MSG_SEQ_AT = 10  # u64
HDR_TS_AT = 18  # u32, seconds
FLAGS_AT = 22  # u16
HEAD_BYTES = 24
MIN_FRAME = 24
MAX_FRAME = 65535

# ---------------------------------------------------------------------------------------------------------------------
# Body head (offsets from the first byte of the body)
# ---------------------------------------------------------------------------------------------------------------------
BODY_TYPE_AT = 0  # u8
BODY_SEQ_AT = 4  # u32
BODY_TS_AT = 8  # u64, nanoseconds
BODY_HEAD_BYTES = 16


@dataclass(frozen=True)
class Field:
    """One field of a typed body: ``kind`` is ``char``, ``u32``, ``u64`` or ``f64``; ``width`` in bytes."""

    name: str
    kind: str
    offset: int
    width: int


@dataclass(frozen=True)
class Layout:
    """A typed message body: its codes, its size including tail padding, and its fields after the body head."""

    name: str
    codes: tuple[int, ...]
    size: int
    fields: tuple[Field, ...]


def _layout(name: str, codes: tuple[int, ...], size: int, *fields: tuple[str, str, int, int]) -> Layout:
    return Layout(name, codes, size, tuple(Field(*f) for f in fields))


# ---------------------------------------------------------------------------------------------------------------------
# The typed bodies
# ---------------------------------------------------------------------------------------------------------------------
LAYOUTS = {
    "order_new": _layout(
        "order_new", (ORDER_NEW,), 128,
        ("market", "char", 16, 16),
        ("instrument", "char", 32, 32),
        ("broker", "char", 64, 32),
        ("order_id", "u64", 96, 8),
        ("price", "f64", 104, 8),
        ("quantity", "u32", 112, 4),
        ("side", "char", 116, 1),
        ("order_type", "char", 117, 1),
    ),
    "order_update": _layout(
        "order_update", (ORDER_UPDATE,), 128,
        ("market", "char", 16, 16),
        ("instrument", "char", 32, 32),
        ("broker", "char", 64, 32),
        ("order_id", "u64", 96, 8),
        ("new_price", "f64", 104, 8),
        ("new_quantity", "u32", 112, 4),
        ("old_quantity", "u32", 116, 4),
        ("side", "char", 120, 1),
    ),
    "order_cancel": _layout(
        "order_cancel", (ORDER_CANCEL,), 120,
        ("market", "char", 16, 16),
        ("instrument", "char", 32, 32),
        ("broker", "char", 64, 32),
        ("order_id", "u64", 96, 8),
        ("cancelled_qty", "u32", 104, 4),
        ("side", "char", 108, 1),
        ("cancel_reason", "char", 109, 1),
    ),
    "trade": _layout(
        "trade", (TRADE,), 112,
        ("market", "char", 16, 16),
        ("instrument", "char", 32, 32),
        ("trade_id", "u64", 64, 8),
        ("bid_order_id", "u64", 72, 8),
        ("ask_order_id", "u64", 80, 8),
        ("price", "f64", 88, 8),
        ("quantity", "u32", 96, 4),
        ("aggressor_side", "char", 100, 1),
        ("trade_condition", "char", 101, 1),
    ),
    "quote": _layout(
        "quote", (QUOTE_BID, QUOTE_ASK), 88,
        ("market", "char", 16, 16),
        ("instrument", "char", 32, 32),
        ("price", "f64", 64, 8),
        ("quantity", "u32", 72, 4),
        ("num_orders", "u32", 76, 4),
    ),
}

LAYOUT_BY_CODE = {code: layout for layout in LAYOUTS.values() for code in layout.codes}

# ---------------------------------------------------------------------------------------------------------------------
# The three measurements, their message types, and the add/set calls one message of a type makes
# ---------------------------------------------------------------------------------------------------------------------
MEASUREMENTS = {
    "orders": (ORDER_NEW, ORDER_UPDATE, ORDER_CANCEL),
    "trades": (TRADE,),
    "quotes": (QUOTE_BID, QUOTE_ASK),
}
UPDATES_PER_MESSAGE = {
    ORDER_NEW: 3,
    ORDER_UPDATE: 1,
    ORDER_CANCEL: 2,
    TRADE: 5,
    QUOTE_BID: 3,
    QUOTE_ASK: 3,
}

# Fixed value: most connections one job reads side by side
MAX_CONNECTIONS = 64

FRAME_SCHEMA = T.StructType([
    T.StructField("connection_id", T.LongType()),
    T.StructField("recv_order", T.LongType()),
    T.StructField("frame", T.BinaryType()),
])

FEED_SCHEMA = T.StructType([
    T.StructField("recv_order", T.LongType()),
    T.StructField("connection_id", T.LongType()),
    T.StructField("msg_seq_num", T.LongType()),
    T.StructField("ts_ns", T.LongType()),
    T.StructField("msg_type", T.IntegerType()),
    T.StructField("market", T.StringType()),
    T.StructField("instrument", T.StringType()),
    T.StructField("broker", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("quantity", T.LongType()),
])

# One update of a tagged metric in long form: exactly one of the three values is set.
UPDATE_SCHEMA = T.StructType([
    T.StructField("measurement", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ts_ns", T.LongType()),
    T.StructField("recv_order", T.LongType()),
    T.StructField("field", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("v_long", T.LongType()),
    T.StructField("v_double", T.DoubleType()),
    T.StructField("v_string", T.StringType()),
])
