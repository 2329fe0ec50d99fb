"""Vocabulary files of the sentencepiece kind (public format), and exact merge-type encoding by backtracking.

Plain Python helpers that run inside tasks; :mod:`tickloom.llm.pieces` applies them to tables.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import regex

SPACE = "▁"

# Kinds of pieces, model type, and field numbers of the public model format
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3

# Units whose ids one worker remembers: at half of this they become the older ones, and older ones not met again since go.
CACHE_UNITS = 300_000
# Pairs of pieces whose fit one worker remembers; above this the memory starts afresh.
CACHE_PAIRS = 200_000
# Longer units are not remembered.
CACHE_CHARS = 64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    bos: int
    eos: int
    unknown_surface: str


@lru_cache(maxsize=4)
def read_model(data: bytes) -> PieceModel:
    """A model file's content. Raises ValueError for models that need normalisation or are not of the merge type."""
    pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
    for number, value in _fields(data):
        if number == PIECES:
            entry = dict(_fields(value))
            pieces.append(entry[1].decode())
            scores.append(struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0)
            kinds.append(entry.get(3, NORMAL))
        elif number == TRAINER:
            trainer = dict(_fields(value))
        elif number == NORMALIZER:
            normalizer = dict(_fields(value))
    plain = not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1)
    if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24) or not plain:
        raise ValueError("only merge-type models with byte fallback, a leading space and no normalisation are supported")
    known = {p for p, kind in zip(pieces, kinds) if kind == NORMAL}
    if {USER_DEFINED, UNUSED} & set(kinds) or any(c not in known for p in known for c in p):
        raise ValueError("models with user-defined or unused pieces, or with pieces of unknown characters, are not supported")
    return PieceModel(
        tuple(pieces), tuple(scores), tuple(kinds), trainer.get(41, 1), trainer.get(42, 2),
        trainer.get(44, b" \xe2\x81\x87 ").decode(),
    )


class Encoder(dict):
    """Ids of a text. As a dictionary it maps units to their ids (little-endian unsigned 32-bit), encoding unseen ones.

    Pieces are held with plain spaces, so that most texts stay strings of one byte a letter: smaller, and faster to cut and look up.
    """

    # No piece goes on after a word with a space, nor from a letter to something else: texts are cut there, exactly.
    UNITS = regex.compile(r" *\p{L}+| *[^\p{L} ]+| +")

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model
        # Pieces with spaces of their own are never met: spaces of a text stand for the other kind.
        used = {p.replace(SPACE, " "): i for i, p in enumerate(model.pieces) if model.kinds[i] == NORMAL and " " not in p}
        self.ids = {p: struct.pack("<I", i) for p, i in used.items()}
        self.bytes = {int(p[3:5], 16): struct.pack("<I", i) for i, p in enumerate(model.pieces) if model.kinds[i] == BYTE}
        self.known = {p for p in self.ids if len(p) == 1}
        for p in self.ids:
            if len(self.UNITS.findall(p)) != 1:
                raise ValueError(f"piece {p!r} lies across a place where texts are cut")
        scores = {p: model.scores[i] for p, i in used.items()}
        place = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: place[score] for p, score in scores.items()}
        # The length of the longest piece that begins with the two characters.
        self.reach: dict[str, int] = {}
        for p in self.ids:
            self.reach[p[:2]] = max(len(p), self.reach.get(p[:2], 1))
        # The longest piece that is a proper prefix of a piece, "" for single characters.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), "") for p in self.ids}
        self.fits: dict[str, dict[str, bool]] = {}
        self.judged = 0  # pairs in it
        self.older: dict[str, bytes] = {}
        self.ends = struct.pack("<I", model.bos), struct.pack("<I", model.eos)

    def encode(self, text: str | None) -> bytes:
        """All ids with begin and end; None is taken as empty."""
        if not text:
            return self.ends[0] + self.ends[1]
        if len(self) > CACHE_UNITS // 2:
            self.older = dict(self)
            self.clear()
        if self.judged > CACHE_PAIRS:
            self.fits.clear()
            self.judged = 0
        units = self.UNITS.findall(" " + text.replace(SPACE, " "))
        return b"".join((self.ends[0], *map(self.__getitem__, units), self.ends[1]))

    def __missing__(self, unit: str) -> bytes:
        packed = self.older.get(unit)
        if packed is None:
            if self.known.issuperset(unit):
                packed = b"".join(map(self.ids.__getitem__, self.split(unit)))
            else:
                packed = self._with_bytes(unit)
            if len(unit) > CACHE_CHARS:
                return packed
        self[unit] = packed
        return packed

    def _with_bytes(self, unit: str) -> bytes:
        """Ids of a unit with unknown characters, which become ids of their bytes."""
        out: list[bytes] = []
        ids, start = self.ids, 0
        for at, char in enumerate(unit):
            if char not in ids:
                out += [ids[p] for p in self.split(unit[start:at])]
                out += [self.bytes[b] for b in char.encode()]
                start = at + 1
        out += [ids[p] for p in self.split(unit[start:])]
        return b"".join(out)

    def split(self, text: str) -> list[str]:
        """The pieces of a text of known characters.

        At each place the longest piece is tried first; it may follow the piece before if merging the two anew gives the two again.
        Places that led nowhere are marked.
        """
        ids, reach, shorter, fits, size = self.ids, self.reach, self.shorter, self.fits, len(text)
        taken: list[str] = []
        before, at, dead, row = "", 0, 0, fits.get("") or {}
        while at < size:
            piece = text[at : at + reach.get(text[at : at + 2], 1)]
            while piece not in ids:
                piece = piece[:-1]
            while True:
                while piece:
                    if not dead >> (at + len(piece)) & 1:
                        known = row.get(piece)
                        if known is None:
                            known = self._fits(before, piece)
                            row = fits[before]
                        if known:
                            break
                    piece = shorter[piece]
                if piece:
                    break
                dead |= 1 << at
                if not taken:
                    raise ValueError(f"no encoding of {text[:40]!r}")
                last = taken.pop()
                at -= len(last)
                piece = shorter[last]
                before = taken[-1] if taken else ""
                row = fits.get(before) or {}
            taken.append(piece)
            at += len(piece)
            before = piece
            row = fits.get(before) or {}
        return taken

    def _fits(self, before: str, piece: str) -> bool:
        """Whether merging the two from characters gives the two again."""
        row = self.fits.get(before)
        if row is None:
            row = self.fits[before] = {}
        known = row.get(piece)
        if known is None:
            known = row[piece] = self.merge(before + piece) == ([before, piece] if before else [piece])
            self.judged += 1
        return known

    def merge(self, text: str) -> list[str]:
        """Merging by score, leftmost first among equals: the definition. For short texts."""
        parts, rank, none = list(text), self.ranks.get, len(self.ranks)
        order = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while order and (best := min(order)) < none:
            i = order.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i:
                order[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(order):
                order[i] = rank(parts[i] + parts[i + 1], none)
        return parts


class Decoder:
    """The text of ids."""

    def __init__(self, model: PieceModel):
        self.model = model
        surface = {CONTROL: lambda p: "", UNKNOWN: lambda p: model.unknown_surface, NORMAL: lambda p: p.replace(SPACE, " ")}
        self.table = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else surface[kind](p).encode()
            for p, kind in zip(model.pieces, model.kinds)
        ]
        # None, which cannot be joined, for begin and end ids: texts with one inside are decoded by runs.
        self.joined = list(self.table)
        for i in (model.bos, model.eos):
            if model.kinds[i] == CONTROL:
                self.joined[i] = None

    def decode(self, packed: bytes) -> str:
        """Ids as little-endian unsigned 32-bit. Begin and end ids give nothing; the space before the text is taken off."""
        ids = struct.unpack(f"<{len(packed) // 4}I", packed)
        while ids and ids[0] == self.model.bos:
            ids = ids[1:]
        while ids and ids[-1] == self.model.eos:
            ids = ids[:-1]
        kinds = self.model.kinds
        first = next((i for i in ids if kinds[i] != CONTROL), None)
        try:
            text = b"".join(map(self.joined.__getitem__, ids)).decode()
        except (TypeError, UnicodeDecodeError):
            text = self._by_runs(ids)
        return text[1:] if first is not None and self.model.pieces[first].startswith(SPACE) else text

    def _by_runs(self, ids) -> str:
        out, run = [], b""
        for i in ids:
            if self.model.kinds[i] == BYTE:
                run += self.table[i]
                continue
            out.append(_bytes_to_text(run))
            out.append(self.table[i].decode())
            run = b""
        return "".join(out) + _bytes_to_text(run)


def _bytes_to_text(run: bytes) -> str:
    """UTF-8, with one replacement character for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(run):
        for size in range(1, 5):
            try:
                out.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)
