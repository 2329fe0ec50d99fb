"""Nested rows as indented text, one text per row.

The expression is built once from the schema and runs as built-in functions. What a Spark type cannot say is taken from the
column metadata: ``type_name`` (struct), ``char_width`` (fixed char field), ``char`` (single character), ``enum`` (labels by
code, keys as text) with ``enum_name``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import text
from tickloom.functions.tags import enum_label

# Nesting depth at which fields are no longer shown, and what stands for them and for NULL
MAX_DEPTH = 10
TOO_DEEP = "(max depth reached)"
NULL = "(null)"


def dump_text(df: DataFrame, name: str | None = None, keep: Sequence[str] = (), type_name: str = "row") -> DataFrame:
    """``keep`` columns and ``text``: all other columns of the row as one struct called ``type_name``.

    With ``name`` the text starts with ``name = ``. The line break after the last brace is left to the text sink.
    """
    shown = T.StructType([f for f in df.schema if f.name not in keep])
    body = _struct(lambda f: F.col(f"`{f}`"), shown, 0, type_name)
    head = [F.lit(f"{name} = ")] if name is not None else []
    return df.select(*keep, F.concat(*head, body).alias("text"))


def dump_value(value: Column, kind: T.DataType, name: str | None = None, metadata: dict | None = None) -> Column:
    """Text of a single value."""
    head = [F.lit(f"{name} = ")] if name is not None else []
    return F.concat(*head, _value(value, kind, 0, metadata or {}))


def _indent(depth: int) -> str:
    return "  " * depth


def _value(value: Column, kind: T.DataType, depth: int, metadata: dict) -> Column:
    if isinstance(kind, T.StructType):
        if kind.names == ["first", "second"]:
            shown = _pair(value, kind, depth)
        else:
            shown = _struct(value.getField, kind, depth, metadata.get("type_name", "struct"))
        return F.when(value.isNull(), NULL).otherwise(shown)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(_array(value, kind, depth, metadata), F.lit(NULL))
    if isinstance(kind, T.MapType):
        return F.coalesce(_map(value, kind, depth, metadata), F.lit(NULL))
    return F.coalesce(_scalar(value, kind, metadata), F.lit(NULL))


def _scalar(value: Column, kind: T.DataType, metadata: dict) -> Column:
    if "enum" in metadata:
        labels = {int(code): label for code, label in metadata["enum"].items()}
        return enum_label(value, labels, metadata.get("enum_name", "enum"))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        if metadata.get("char"):
            return F.concat(F.lit("'"), value, F.lit("'"))
        binary = isinstance(kind, T.BinaryType)
        quoted = F.concat(F.lit('"'), text.printable_bytes(value) if binary else text.printable(value), F.lit('"'))
        if "char_width" in metadata:
            return F.concat(quoted, F.lit(" ("), F.octet_length(value).cast("string"), F.lit(f"/{metadata['char_width']})"))
        return quoted
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return text.general6(value)
    return value.cast("string")


def _struct(get, kind: T.StructType, depth: int, type_name: str) -> Column:
    inner = _indent(depth + 1)
    parts: list[Column] = [F.lit(f"{type_name} {{\n")]
    for f in kind:
        parts.append(F.lit(f"{inner}{f.name} = "))
        parts.append(F.lit(TOO_DEEP) if depth + 1 >= MAX_DEPTH else _value(get(f.name), f.dataType, depth + 1, f.metadata))
        parts.append(F.lit("\n"))
    return F.concat(*parts, F.lit(f"{_indent(depth)}}}"))


def _pair(value: Column, kind: T.StructType, depth: int) -> Column:
    inner = _indent(depth + 1)
    parts: list[Column] = [F.lit("(\n")]
    for f in kind:
        parts += [F.lit(f"{inner}{f.name} = "), _value(value.getField(f.name), f.dataType, depth + 1, f.metadata), F.lit("\n")]
    return F.concat(*parts, F.lit(f"{_indent(depth)})"))


def _array(value: Column, kind: T.ArrayType, depth: int, metadata: dict) -> Column:
    inner = F.lit(_indent(depth + 1))
    rows = F.transform(value, lambda x, i: F.concat(
        inner, F.lit("["), i.cast("string"), F.lit("] = "), _value(x, kind.elementType, depth + 1, metadata), F.lit("\n")
    ))
    return F.concat(_count(value), F.array_join(rows, ""), F.lit(f"{_indent(depth)}}}"))


def _map(value: Column, kind: T.MapType, depth: int, metadata: dict) -> Column:
    inner = _indent(depth + 1)
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    rows = F.transform(F.array_sort(F.map_entries(value), by_key), lambda e: F.concat(
        F.lit(f"{inner}key = "), _value(e["key"], kind.keyType, depth + 1, {}), F.lit("\n"),
        F.lit(f"{inner}val = "), _value(e["value"], kind.valueType, depth + 1, metadata), F.lit("\n"),
    ))
    return F.concat(_count(value), F.array_join(rows, ""), F.lit(f"{_indent(depth)}}}"))


def _count(value: Column) -> Column:
    return F.concat(F.lit("["), F.size(value).cast("string"), F.lit("] {\n"))
