"""Layouts as numpy structured types, and the columns of a batch of frames as Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tickloom import schema as S

_NUMPY = {"u32": "<u4", "u64": "<u8", "f64": "<f8"}
HEAD = [
    ("resp_len", "<u2", S.RESP_LEN_AT), ("resp_seq", "<u8", S.RESP_SEQ_AT), ("msg_seq_num", "<u8", S.MSG_SEQ_AT),
    ("hdr_ts", "<u4", S.HDR_TS_AT), ("flags", "<u2", S.FLAGS_AT), ("msg_type", "u1", S.HEAD_BYTES + S.BODY_TYPE_AT),
    ("body_seq", "<u4", S.HEAD_BYTES + S.BODY_SEQ_AT), ("ts_ns", "<u8", S.HEAD_BYTES + S.BODY_TS_AT),
]


def frame_dtype(layout: S.Layout, head: list[tuple[str, str, int]] = HEAD) -> np.dtype:
    """A frame with this layout as its body; the layout's fields are named ``b_<name>``."""
    fields = head + [(f"b_{x.name}", _NUMPY.get(x.kind, f"S{x.width}"), S.HEAD_BYTES + x.offset) for x in layout.fields]
    names, formats, offsets = zip(*fields)
    return np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": S.HEAD_BYTES + layout.size})


def frames_view(array: pa.Array, dtype: np.dtype, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The frames of a BINARY array (those where ``rows`` is set) as ``dtype``, and their lengths; none is null or shorter.

    Frames at even distances, as those of one type in a capture, are seen in place; others are gathered once.
    """
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    starts, lengths = offsets[:-1], np.diff(offsets)
    if rows is not None:
        starts, lengths = starts[rows], lengths[rows]
    n = len(starts)
    if n == 0:
        return np.zeros(0, dtype), lengths
    data = np.frombuffer(array.buffers()[2], np.uint8)
    steps = np.diff(starts)
    if n > 1 and (steps == steps[0]).all() and steps[0] > 0:
        return np.ndarray((n,), dtype, data, int(starts[0]), (int(steps[0]),)), lengths
    cells = data[starts[:, None].astype(np.int64) + np.arange(dtype.itemsize)]
    return cells.view(dtype)[:, 0], lengths


def u64(values: np.ndarray) -> pa.Array:
    """Full unsigned range, as DECIMAL(20,0)."""
    cells = np.zeros((len(values), 2), "<u8")
    cells[:, 0] = values
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(values), [None, pa.py_buffer(cells)])


def u63(values: np.ndarray) -> pa.Array:
    """As BIGINT; NULL where the unsigned value does not fit."""
    whole = np.ascontiguousarray(values).astype("<u8", copy=False)
    return pa.array(whole.view("<i8"), mask=whole >= np.uint64(1 << 63))


def texts(values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Fixed char fields: cut at the first NUL, or at their width if they have none. Each different content is decoded once."""
    cells = np.ascontiguousarray(values)
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(cells.dtype.itemsize), len(cells), [None, pa.py_buffer(cells.tobytes())])
    coded = fixed.dictionary_encode()
    named = pa.array([v.as_py().split(b"\0", 1)[0].decode("latin-1") for v in coded.dictionary], pa.string())
    indices = coded.indices if null is None else pa.array(coded.indices.to_numpy(), mask=null)
    return named.take(indices)
