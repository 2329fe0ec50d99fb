"""Running and neighbour values over one long ordered sequence, without one long sort in one task.

A window over the whole sequence (or over one of a few connections) would send everything to one task. Here the order
axis is cut into chunks of fixed width; the window runs inside (keys, chunk), and a table with one row per chunk carries
the state from chunk to chunk. That table is treated the same way again while ``levels`` allows, so the longest window is
about ``chunk`` rows for sequences of up to ``chunk ** levels`` positions. The rows are shuffled once, by (keys, chunk); the
carry comes in by an equi-join on the same columns.

``order`` must be a BIGINT column, unique within the keys, so that a chunk cannot hold more than ``chunk`` rows. The keys
must not be NULL: the carry joins on plain equality, which keeps the partitioning of the window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 1 << 20
LEVELS = 2

_RUNNING = {"sum": F.sum, "max": F.max, "min": F.min}


def chunk_of(order: Column, chunk: int) -> Column:
    return F.call_function("div", order - F.pmod(order, F.lit(chunk)), F.lit(chunk))


def expanded(df: DataFrame, first: str, last: str, name: str, width: int = 1 << 12) -> DataFrame:
    """A row for every number from column ``first`` to ``last``, as ``name``; in two steps, so that no row holds a long array."""
    low, high = F.col(first), F.col(last)
    slots = df.withColumn("_slot", F.explode(F.sequence(chunk_of(low, width), chunk_of(high, width))))
    start = F.col("_slot") * width
    numbers = F.sequence(F.greatest(low, start), F.least(high, start + (width - 1)))
    return slots.select(*df.columns, F.explode(numbers).alias(name))


def _attach(rows: DataFrame, carry: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return rows.join(carry.select(*keys, *columns), list(keys), "left")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    aggs: dict[str, tuple[str, str]],
    exclusive: bool = False,
    chunk: int = CHUNK,
    levels: int = LEVELS,
) -> DataFrame:
    """Add ``name: (function, column)`` running aggregates in ``order`` within ``keys``.

    ``function`` is ``sum``, ``max`` or ``min``. ``exclusive`` leaves the row itself out (NULL on the first row).
    """
    end = -1 if exclusive else 0
    frame = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    if levels <= 1:
        w = frame.orderBy(order).rowsBetween(W.unboundedPreceding, end)
        return df.select("*", *[_RUNNING[f](c).over(w).alias(n) for n, (f, c) in aggs.items()])

    slot = f"_chunk{levels}"  # one name per level: the level above orders by this column
    chunked = df.withColumn(slot, chunk_of(F.col(order), chunk))
    w = W.partitionBy(*keys, slot).orderBy(order).rowsBetween(W.unboundedPreceding, end)
    inside = chunked.select("*", *[_RUNNING[f](c).over(w).alias(f"_in_{n}") for n, (f, c) in aggs.items()])

    per_chunk = chunked.groupBy(*keys, slot).agg(*[_RUNNING[f](c).alias(f"_of_{n}") for n, (f, c) in aggs.items()])
    carry = running(
        per_chunk, keys, slot, {f"_before_{n}": (f, f"_of_{n}") for n, (f, _) in aggs.items()},
        exclusive=True, chunk=chunk, levels=levels - 1,
    )
    joined = _attach(inside, carry, [*keys, slot], [f"_before_{n}" for n in aggs])
    out = []
    for name, (function, _) in aggs.items():
        before, own = F.col(f"_before_{name}"), F.col(f"_in_{name}")
        if function == "sum":
            both = F.coalesce(before + own, own, before)
        else:
            both = (F.greatest if function == "max" else F.least)(before, own)  # NULLs are skipped
        out.append(both.alias(name))
    return joined.select(*df.columns, *out)


def following(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, str],
    backwards: bool = False,
    chunk: int = CHUNK,
    levels: int = LEVELS,
    edges_from: DataFrame | None = None,
) -> DataFrame:
    """Add ``name: column`` values of the next row in ``order`` within ``keys`` (the previous row if ``backwards``).

    ``edges_from`` may give rows with the same first and last row per chunk that are cheaper to get than ``df``, such as the
    rows before duplicates were removed.
    """
    step = F.lag if backwards else F.lead
    if levels <= 1:
        w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(order)
        return df.select("*", *[step(c).over(w).alias(n) for n, c in columns.items()])

    edge_of = F.max_by if backwards else F.min_by
    slot = f"_chunk{levels}"  # one name per level: the level above orders by this column
    chunked = df.withColumn(slot, chunk_of(F.col(order), chunk))
    w = W.partitionBy(*keys, slot).orderBy(order)
    at_edge = step(F.lit(True)).over(w).isNull()
    inside = chunked.select("*", at_edge.alias("_edge"), *[step(c).over(w).alias(f"_in_{n}") for n, c in columns.items()])

    source = chunked if edges_from is None else edges_from.withColumn(slot, chunk_of(F.col(order), chunk))
    edges = source.groupBy(*keys, slot).agg(*[edge_of(c, order).alias(f"_of_{n}") for n, c in columns.items()])
    carry = following(
        edges, keys, slot, {f"_next_{n}": f"_of_{n}" for n in columns}, backwards, chunk, levels - 1
    )
    joined = _attach(inside, carry, [*keys, slot], [f"_next_{n}" for n in columns])
    out = [F.when(F.col("_edge"), F.col(f"_next_{n}")).otherwise(F.col(f"_in_{n}")).alias(n) for n in columns]
    return joined.select(*df.columns, *out)
