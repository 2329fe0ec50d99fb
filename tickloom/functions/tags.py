"""Tag sets and enum labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_set(tags: Mapping[str, Column | str]) -> Column:
    """MAP of tag name to text, entries in key order.

    Grouping, joining and comparing by the map treat two orders of the same entries as equal; a repeated key is an error.
    """
    parts = []
    for key in sorted(tags):
        value = tags[key]
        parts += [F.lit(key), (F.col(value) if isinstance(value, str) else value).cast("string")]
    return F.create_map(*parts)


def canonical(tags: Column) -> Column:
    """The same map with its entries in key order, for output that shows the entries one after another."""
    return F.map_from_entries(F.array_sort(F.map_entries(tags)))


def enum_label(code: Column, labels: Mapping[int, str], type_name: str = "enum") -> Column:
    """Label of an enum code; a code without a label reads ``type_name(code)``."""
    other = F.concat(F.lit(f"{type_name}("), code.cast("string"), F.lit(")"))
    if not labels:
        return other
    table = F.create_map(*[F.lit(x) for item in sorted(labels.items()) for x in item])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(table, code.cast("int")), other))
