"""Little-endian fields of BINARY columns as built-in expressions (no Python at run time).

Offsets are 0-based and ``buf`` is a column name. A 32-bit word is read by one ``hex`` and one ``conv`` and then byte-swapped
with shifts; wider values are put together from two words, so code generation can share the words between the fields that
use them. The expressions are written as SQL text: one text is much faster to build than many small columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _big_endian(buf: str, offset: int, width: int) -> str:
    return f"bigint(conv(hex(substring({buf}, {offset + 1}, {width})), 16, 10))"


def _word(buf: str, offset: int) -> str:
    v = _big_endian(buf, offset, 4)
    return f"(shiftleft({v} & 255, 24) | shiftleft({v} & 65280, 8) | (shiftright({v}, 8) & 65280) | shiftright({v}, 24))"


def u8(buf: str, offset: int) -> Column:
    return F.expr(f"int({_big_endian(buf, offset, 1)})")


def u16(buf: str, offset: int) -> Column:
    v = _big_endian(buf, offset, 2)
    return F.expr(f"int(shiftleft({v} & 255, 8) | shiftright({v}, 8))")


def u32(buf: str, offset: int) -> Column:
    return F.expr(_word(buf, offset))


def u64(buf: str, offset: int) -> Column:
    """Full unsigned range, as DECIMAL(20,0)."""
    low, high = _word(buf, offset), _word(buf, offset + 4)
    return F.expr(f"cast(cast({high} as decimal(10,0)) * 4294967296 + cast({low} as decimal(10,0)) as decimal(20,0))")


def u63(buf: str, offset: int) -> Column:
    """As BIGINT; NULL where the unsigned value does not fit (the top bit is set)."""
    low, high = _word(buf, offset), _word(buf, offset + 4)
    return F.expr(f"case when {high} < {1 << 31} then shiftleft({high}, 32) | {low} end")


def f64(buf: str, offset: int) -> Column:
    """IEEE-754 double from sign, exponent and mantissa bits; every step is exact in double arithmetic."""
    low, high = _word(buf, offset), _word(buf, offset + 4)
    exponent = f"(shiftright({high}, 20) & 2047)"
    mantissa = f"(shiftleft({high} & 1048575, 32) | {low})"
    size = f"""
      case {exponent}
        when 0 then double({mantissa}) * {2.0**-1074!r}D
        when 2047 then if({mantissa} = 0, double('infinity'), double('nan'))
        else double({mantissa} + {1 << 52}) * pow(2D, double({exponent} - 1075)) end
    """
    return F.expr(f"case when {high} >= {1 << 31} then -({size}) else {size} end")


def chars(buf: str, offset: int, width: int) -> Column:
    """Fixed char field: cut at the first NUL, or at its width if it has none."""
    return F.expr(f"substring_index(decode(substring({buf}, {offset + 1}, {width}), 'ISO-8859-1'), char(0), 1)")


def read(buf: str, kind: str, offset: int, width: int) -> Column:
    if kind == "char":
        return chars(buf, offset, width)
    return {"u32": u32, "u64": u64, "f64": f64}[kind](buf, offset)
