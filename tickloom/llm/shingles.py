"""Hashed words and word shingles of whole texts, in numpy, inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes that separate words
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"

# Bytes hashed at a time.
PART = 1 << 16

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SEPARATORS)] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a public mixing function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


# Powers of the base for each place, and of its inverse, for parts and some more; longer ones are made when needed.
_POWERS = _powers(_BASE, PART + 1024)
_BACKS = _powers(pow(_BASE, -1, 1 << 64), PART + 1024)
# What a byte adds to a word's sum; separators add nothing.
_VALUES = np.where(_IS_SPACE, 0, np.arange(1, 257)).astype(np.uint64)
_FOLDED = np.where(_IS_SPACE, 0, _FOLD.astype(np.int64) + 1).astype(np.uint64)


def word_hashes(text: bytes, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, with A-Z lower-cased if ``fold``."""
    return words(text, fold)[0]


def words(text: bytes, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where they start."""
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(text):
        end = at + PART
        while end < len(text) and text[end] not in SEPARATORS:
            end += 1
        found, places = _hashed(np.frombuffer(text, np.uint8, min(end, len(text)) - at, at), fold)
        hashes.append(found)
        starts.append(places + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def _hashed(raw: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    space = _IS_SPACE[raw]
    begins = space[:-1] > space[1:]
    starts = np.flatnonzero(begins) + 1
    if not space[0]:
        starts = np.concatenate([[0], starts])
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    powers, backs = _POWERS, _BACKS
    if len(raw) > len(powers):
        powers, backs = _powers(_BASE, len(raw)), _powers(pow(_BASE, -1, 1 << 64), len(raw))
    values = (_FOLDED if fold else _VALUES)[raw]
    values *= powers[: len(raw)]
    return _mixed(np.add.reduceat(values, starts) * backs[starts]), starts


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each row's text as UTF-8; null as empty."""
    for row in column.cast(pa.large_binary()):
        yield row.as_py() or b""


def in_parts(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of the batches in parts of about ``size`` bytes of a column, or one longer row; the number of rows in a batch says little."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; of all words as one if there are fewer; empty without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        total = (total + words[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(32)
    if len(words) < width:
        total += np.uint64(len(words))  # fewer words than a shingle has
    return np.unique(_mixed(total))


def digest(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a sorted set."""
    with np.errstate(over="ignore"):
        a = np.add.reduce(_mixed(values + np.uint64(1)), initial=np.uint64(len(values)))
        b = np.add.reduce(_mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(3), initial=np.uint64(7))
    return int(_mixed(np.array([a]))[0].astype(np.int64)), int(_mixed(np.array([b]))[0].astype(np.int64))
