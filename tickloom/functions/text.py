"""Text forms of numbers and strings, as built-in column expressions.

``format_string`` rounds the shortest decimal form of a double, while C's ``printf`` and most databases round its exact
binary value; the two differ on ties such as ``0.0000005``. The number forms here round the exact value, half to even:
the product with a power of ten is taken together with its rounding error (split multiplication), so the comparison with
one half is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITTER = 134217729.0  # 2**27 + 1: cuts a double into two halves of 26 bits
TWO_63 = 9223372036854775808.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _let(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` standing for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _apply(x: Column, name: str, body: str) -> Column:
    """The SQL text ``body`` over ``name`` applied to a column. One text is much faster to build than many small columns."""
    return F.get(F.call_function("transform", F.array(x.cast("double")), F.expr(f"{name} -> {body}")), F.lit(0))


def _scaled(x: str, ten: str) -> str:
    """``x * ten`` rounded exactly to a whole number, half to even.

    ``ten`` is a power of ten up to 10**9, ``x >= 0`` and the result is below 2**52.
    """
    high = f"(s.x * {SPLITTER}D - (s.x * {SPLITTER}D - s.x))"
    error = f"({high} * s.ten - s.x * s.ten) + (s.x - {high}) * s.ten"
    product = _let(f"named_struct('x', {x}, 'ten', {ten})", "s", f"named_struct('p', s.x * s.ten, 'e', {error})")
    above = "((q.p - floor(q.p) - 0.5D) + q.e)"
    up = f"case when {above} > 0 or ({above} = 0 and floor(q.p) % 2 = 1) then 1 else 0 end"
    return _let(product, "q", f"floor(q.p) + {up}")


def _far_from_tie(value: str, margin: float) -> str:
    """Whether rounding to a whole number cannot depend on the last bits."""
    return f"abs({value} - floor({value}) - 0.5D) > {margin}D"


def _sign(x: str) -> str:
    return f"case when {x} < 0 or ({x} = 0 and startswith(string({x}), '-')) then '-' else '' end"


def _special(x: str) -> str:
    return (
        f"case when isnan({x}) then 'nan' when {x} = double('infinity') then 'inf' when {x} = double('-infinity') then '-inf' end"
    )


def _trimmed(text: str) -> str:
    return f"trim(trailing '.' from trim(trailing '0' from {text}))"


def fixed6(x: Column) -> Column:
    """``%.6f`` without trailing zeros and without a trailing dot. From 2**63 on, Java's digits are used.

    Values that are not near a tie, nearly all, are formatted directly.
    """
    plain = f"abs(x) < 1e8D and {_far_from_tie('abs(x) * 1e6D', 0.1)}"
    direct = _trimmed("format_string('%.6f', x)")
    digits = "lpad(string(t.m % 1000000), 6, '0')"
    whole = "string(t.i + case when t.m = 1000000 then 1 else 0 end)"
    text = f"concat({_sign('t.x')}, {_trimmed(f'concat({whole}, {chr(39)}.{chr(39)}, {digits})')})"
    parts = f"named_struct('x', x, 'i', floor(abs(x)), 'm', {_scaled('abs(x) - floor(abs(x))', '1e6D')})"
    body = f"""
      case when {plain} then {direct}
        when x is null then null
        when isnan(x) or abs(x) = double('infinity') then {_special('x')}
        when abs(x) >= {TWO_63}D then {_trimmed("format_string('%.6f', x)")}
        else {_let(parts, 't', text)} end
    """
    return _apply(x, "x", body)


def general6(x: Column) -> Column:
    """Six significant digits, ``%g`` style. Below 1e-4 and from 2**63 on, Java's digits are used.

    Values between 1 and 999999 that are not near a tie are formatted directly.
    """
    cases = []
    for digits in range(5, 0, -1):
        size = f"abs(x) * 1e{digits}D"
        direct = _trimmed(f"format_string('%.{digits}f', x)")
        cases.append(f"when abs(x) < 1e{6 - digits}D and abs(x) >= 1e{5 - digits}D and {_far_from_tie(size, 1e-3)} then {direct}")
    cases.append(
        f"when abs(x) < 999999D and abs(x) >= 1e5D and {_far_from_tie('abs(x)', 1e-3)} then format_string('%.0f', x)"
    )
    kept = "((floor(b.a) - floor(b.a) % b.u) div b.u)"
    rest, half = "(floor(b.a) % b.u)", "(b.u div 2)"
    up = f"({rest} > {half} or ({rest} = {half} and (b.a > floor(b.a) or {kept} % 2 = 1)))"
    large = _let("named_struct('a', g.a, 'u', bigint(pow(10D, double(g.e - 5))))", "b", f"{kept} + case when {up} then 1 else 0 end")
    small = _scaled("g.a", "pow(10D, double(5 - g.e))")
    rounded = f"named_struct('x', g.x, 'e', g.e, 'r', case when g.e < 6 then {small} else {large} end)"
    carried = """named_struct('x', r.x, 'e', r.e + case when r.r = 1000000 then 1 else 0 end,
      'd', string(case when r.r = 1000000 then 100000 else r.r end))"""
    science = f"concat({_trimmed("concat(left(w.d, 1), '.', substring(w.d, 2))")}, 'e+', lpad(string(w.e), 2, '0'))"
    below = "concat('0.', trim(trailing '0' from concat(repeat('0', -w.e - 1), w.d)))"
    plain = _trimmed("concat(left(w.d, w.e + 1), '.', substring(w.d, w.e + 2))")
    text = f"concat({_sign('w.x')}, case when w.e >= 6 then {science} when w.e < 0 then {below} else {plain} end)"
    exact = _let("named_struct('x', x, 'a', abs(x), 'e', int(floor(log10(abs(x)))))", "g",
                 _let(rounded, "r", _let(carried, "w", text)))
    java = "regexp_replace(format_string('%.5e', x), '[.]?0*e', 'e')"
    body = f"""
      case {' '.join(cases)}
        when x is null then null
        when isnan(x) or abs(x) = double('infinity') then {_special('x')}
        when x = 0 then concat({_sign('x')}, '0')
        when abs(x) < 1e-4D or abs(x) >= {TWO_63}D then {java}
        else {exact} end
    """
    return _apply(x, "x", body)


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_measurement(text: Column) -> Column:
    """Line protocol: backslash before comma and space."""
    return _replace_all(text, [(",", "\\,"), (" ", "\\ ")])


def escape_tag(text: Column) -> Column:
    """Line protocol: backslash before comma, equals sign and space (tag values, and all keys)."""
    return _replace_all(text, [(",", "\\,"), ("=", "\\="), (" ", "\\ ")])


def line_string(text: Column) -> Column:
    """Line protocol string field: quoted, backslash before backslash and quote."""
    return F.concat(F.lit('"'), _replace_all(text, [("\\", "\\\\"), ('"', '\\"')]), F.lit('"'))


def csv_text(text: Column) -> Column:
    """CSV text value: quoted, with doubled quotes, only where it holds a comma, quote or line break."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\\n\\r]'), quoted).otherwise(text)


def printable(text: Column) -> Column:
    r"""Escape ``\ " \n \r \t`` by name and every other byte outside printable ASCII as ``\xHH`` (UTF-8 bytes).

    Texts that need no escape are passed through. Otherwise the text is cut at the borders between printable and other
    bytes, so the work grows with the number of runs, not of characters.
    """
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.when(text.rlike(r"^[ !#-\[\]-~]*\z"), text).otherwise(_escape(latin))


def printable_bytes(data: Column) -> Column:
    """:func:`printable` for BINARY."""
    return _escape(F.decode(data, "ISO-8859-1"))


def _escape(latin: Column) -> Column:
    named = _replace_all(latin, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")])

    def by_run(text: Column) -> Column:
        runs = F.split(text, "(?<=[ -~])(?=[^ -~])|(?<=[^ -~])(?=[ -~])")
        hexed = lambda run: F.regexp_replace(F.lower(F.hex(F.encode(run, "ISO-8859-1"))), "(..)", "\\\\x$1")
        return F.array_join(F.transform(runs, lambda run: F.when(run.rlike("^[ -~]"), run).otherwise(hexed(run))), "")

    return let(named, lambda text: F.when(text.rlike("[^ -~]"), by_run(text)).otherwise(text))
