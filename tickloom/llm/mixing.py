"""Mixing sources to target weights by systematic sampling.

Within a source, expected copies are summed in the order of (size, key), one random offset is added, and a document is emitted
once for each integer its stretch of the sum crosses. Sorted by size, the words a source gives stay within about one document
of its target. Copies are counted in units of 2**-24, so sums are exact and reruns agree.

The order is cut by range into partitions of even size, whatever the sources' shares: each row knows its partition and its
place there, and a table with one row per (partition, source) says how many rows of the source come before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.session import materialize, small_side

# Fixed value: what separates words
WORD = r"[^\x20\x09-\x0D]+"

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
UNIT = 1 << 24


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source, source_size`` (one row per source) with ``target`` added.

    Sources in code point order, null last, take the weights in turn. All targets together are ``share`` times all sizes, in
    proportion to the weights; none is above ``cap`` times its source's size, and what is cut off goes to the others. Sources
    filled to the brim are those with the least size per weight, so one look at the sources in that order settles all.
    """
    by_name = W.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    weighed = sizes.withColumn(
        "_w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, len(weights)).cast("int") + 1)
    )
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("_w"), F.asc_nulls_last("source"))
    filled = F.coalesce(F.sum(cap * F.col("source_size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_weights = F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything)
    rows = weighed.select("*", F.row_number().over(order).alias("_n"), ((share * total - filled) / open_weights).alias("_level"))
    full = (cap * F.col("source_size")).cast("double")
    level = F.min_by(F.when(full >= F.col("_level") * F.col("_w"), F.col("_level")), F.when(full >= F.col("_level") * F.col("_w"), F.col("_n")))
    settled = rows.withColumn("_final", level.over(everything))
    return settled.select(
        "source", "source_size", F.least(full, F.coalesce(F.col("_final") * F.col("_w"), full)).alias("target")
    )


def offset(source: Column, seed: int) -> Column:
    """The random start of a source, below ``UNIT``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 6), 16, 10).cast("long")


def mixed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE, cap: int = CAP, seed: int = 0,
) -> DataFrame:
    """``key, size, source_size, target, copies`` for each row of ``docs``.

    A null text has size 0; a null source is a source of its own; rows with a null key come first among those of their size.
    Repeated rows are drawn one by one. Documents of a source without words get no copies. Other columns are not read, and
    clash with nothing. An empty table gives an empty one.
    """
    rows = _drawn(docs, [key], key, text, source, weights, share, cap, seed)
    return rows.select("_row.*", "size", "source_size", "target", "copies")


def repeated(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE, cap: int = CAP, seed: int = 0,
) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as :func:`mixed` takes it."""
    rows = _drawn(docs, docs.columns, key, text, source, weights, share, cap, seed).filter("copies > 0")
    return rows.select("_row", F.explode(F.expr("sequence(1, copies)"))).select("_row.*")


def _drawn(docs, columns, key, text, source, weights, share, cap, seed) -> DataFrame:
    rows = docs.select(
        F.struct(*[F.col(c).alias(c) for c in columns]).alias("_row"),
        F.col(key).alias("_key"), F.col(source).cast("string").alias("source"), words(F.col(text).cast("string")).alias("size"),
    )
    placed = rows.repartitionByRange("source", "size", "_key").sortWithinPartitions("source", "size", "_key")
    placed = materialize(placed.select("*", F.monotonically_increasing_id().alias("_at")).drop("_key"))
    part = F.shiftright("_at", 33)
    parts = placed.groupBy(part.alias("_part"), "source").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows"), F.sum("size").alias("_size")
    )
    parts = materialize(parts)
    goals = targets(parts.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, cap)
    before = F.sum("_rows").over(W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0)))
    named = goals.withColumnRenamed("source", "_source")
    each = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    known = parts.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "_part", F.col("source").alias("_source"), "_first", "_before", "source_size", "target",
        each.alias("_each"), offset(F.col("source"), seed).alias("_start"),
    )
    known, _ = small_side(known)
    joined = placed.withColumn("_in", part).join(
        known, (F.col("_in") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source"))
    )
    place = F.col("_before") + F.col("_at") - F.col("_first")
    upto = F.shiftright((place + 1) * F.col("_each") + F.col("_start"), 24)
    below = F.shiftright(place * F.col("_each") + F.col("_start"), 24)
    return joined.select("_row", "size", "source_size", "target", (upto - below).cast("int").alias("copies"))


SQL = r"""
with words as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents
), sizes as (
  select source, sum(size)::bigint source_size from words group by source
), weighed as (
  select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] w from sizes
), levels as (
  select *, row_number() over o n,
    (1.5::double * (sum(source_size) over ())::double - coalesce(sum(2 * source_size) over (o rows between unbounded preceding and 1 preceding), 0)::double)
      / (sum(w) over (o rows between current row and unbounded following))::double as level
  from weighed window o as (order by source_size::double / w, source nulls last)
), final as (
  select arg_min(level, n) settled from levels where 2.0::double * source_size >= level * w
), goals as (
  select source, source_size, least((2 * source_size)::double, coalesce(settled * w, (2 * source_size)::double)) target
  from levels, final
), placed as (
  select doc_id, size, source_size, target,
    case when source_size > 0 then floor(target / source_size::double * 16777216)::bigint else 0 end each,
    ('0x' || left(md5('0:' || coalesce('=' || words.source, 'null')), 6))::bigint start,
    row_number() over (partition by words.source order by size, doc_id nulls first) place
  from words join goals on words.source is not distinct from goals.source
)
select doc_id, size, source_size, target,
  ((((place * each + start) >> 24) - (((place - 1) * each + start) >> 24)) * size)::bigint taken
from placed
"""
