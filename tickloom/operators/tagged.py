"""Tagged metrics with user-defined tags and fields.

Two forms. The wide form (:class:`Metrics`) fits metrics whose fields are known: one column per field, fields are either added
up or overwritten. The long form has one row per update and allows any mix: a set overwrites, later adds build on it.

Every step aggregates on the map side first, so a tag set that holds a large part of all rows costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import session
from tickloom.functions.buckets import NS_PER_MS, bucket
from tickloom.functions.tags import tag_set
from tickloom.functions.text import csv_text, fixed6
from tickloom.operators.arrival import roll_forward

Expr = Column | str


def _col(value: Expr) -> Column:
    return F.col(value) if isinstance(value, str) else value


@dataclass(frozen=True)
class Metrics:
    """A measurement: tag columns, fields that add up and fields where the last value wins.

    A NULL value does not touch its field. ``order`` is the unique arrival position; it decides which value is last.
    """

    measurement: str
    tags: Mapping[str, Expr]
    adds: Mapping[str, Expr] = field(default_factory=dict)
    sets: Mapping[str, Expr] = field(default_factory=dict)
    ts: str = "ts_ns"
    order: str = "recv_order"

    def __post_init__(self):
        both = set(self.adds) & set(self.sets)
        if both:
            raise ValueError(f"fields both added and set need the long form: {sorted(both)}")

    @property
    def fields(self) -> list[str]:
        return [*self.adds, *self.sets]

    def rows(self, df: DataFrame) -> DataFrame:
        """Only the columns the measurement needs, under their own names."""
        return df.select(
            *[_col(v).cast("string").alias(k) for k, v in self.tags.items()],
            F.col(self.ts).alias("ts_ns"), F.col(self.order).alias("recv_order"),
            *[_col(v).alias(k) for k, v in {**self.adds, **self.sets}.items()],
        )

    def partial(self, rows: DataFrame) -> DataFrame:
        """Combinable state per tag set and ``bucket_ts``: sums, and last values with their positions."""
        aggs = [F.sum(name).alias(name) for name in self.adds]
        for name in self.sets:
            at = F.when(F.col(name).isNotNull(), F.col("recv_order"))
            aggs += [F.max_by(name, at).alias(name), F.max(at).alias(f"{name}_at")]
        return rows.groupBy(*self.tags, "bucket_ts").agg(*aggs)

    def merge(self, partials: DataFrame) -> DataFrame:
        """One state out of many for the same tag set and bucket."""
        aggs = [F.sum(name).alias(name) for name in self.adds]
        for name in self.sets:
            aggs += [F.max_by(name, f"{name}_at").alias(name), F.max(f"{name}_at").alias(f"{name}_at")]
        return partials.groupBy(*self.tags, "bucket_ts").agg(*aggs)

    def finish(self, state: DataFrame) -> DataFrame:
        return state.select(F.lit(self.measurement).alias("measurement"), *self.tags, "bucket_ts", *self.fields)

    def aggregate(self, df: DataFrame, window_ms: int, roll: bool = True) -> DataFrame:
        """The metrics of a batch; late events are rolled forward, or kept in their own bucket if not ``roll``."""
        rows, period = self.rows(df), window_ms * NS_PER_MS
        if roll:
            rows = roll_forward(rows, period)
        else:
            rows = rows.withColumn("bucket_ts", bucket(F.col("ts_ns"), period))
        return self.finish(self.partial(rows))

    def updates(self, df: DataFrame) -> DataFrame:
        """The long form: one row per touched field."""
        types = {f.name: f.dataType for f in self.rows(df).schema}
        parts = []
        for op, names in (("add", self.adds), ("set", self.sets)):
            for name in names:
                parts.append(_update(op, name, types[name]))
        rows = self.rows(df).withColumn("u", F.explode(F.array(*parts))).filter(
            "u.v_long is not null or u.v_double is not null or u.v_string is not null"
        )
        return rows.select(
            F.lit(self.measurement).alias("measurement"), tag_set({k: k for k in self.tags}).alias("tags"),
            "ts_ns", "recv_order", "u.*",
        )


def _update(op: str, name: str, kind: T.DataType) -> Column:
    text = isinstance(kind, T.StringType)
    whole = isinstance(kind, T.IntegralType)
    none = F.lit(None)
    return F.struct(
        F.lit(name).alias("field"), F.lit(op).alias("op"),
        (F.col(name) if whole else none).cast("bigint").alias("v_long"),
        (none if text or whole else F.col(name)).cast("double").alias("v_double"),
        (F.col(name) if text else none).cast("string").alias("v_string"),
    )


_KEY = "measurement string, tags array<struct<key: string, value: string>>, bucket_ts bigint, field string"
_STATE = (
    "key string, set_at bigint, set_long bigint, set_double double, set_string string, "
    "add_long bigint, add_double double, first_add bigint, last_add bigint"
)
# Groups a task holds before it gives all of them out, and numbers that may be added to one text.
HELD = 100_000
MAX_APPENDED = 10_000


def aggregate_updates(updates: DataFrame) -> DataFrame:
    """Value of every field of every (measurement, tags, ``bucket_ts``) from its updates, in arrival order.

    The last set gives the base; adds that arrive after it build on it. Adds before it do not count. Whole numbers stay
    whole until a double takes part. An add to a text appends the number's CSV text (the text so far is CSV-quoted).

    Each task reduces its rows to one state per group: its last set, the sums of the adds after it and the first and last of
    these. Two states make one unless a set of one lies among the adds of the other, so rows in order of arrival, as a feed is stored,
    are reduced in one pass, whatever holds a large part of them. Only groups that are left with such a pair look at their adds again, and
    so do numbers added to a text; a text that would get more than ``MAX_APPENDED`` of them is an error.

    ``tags`` may be a MAP, or an ARRAY of (key, value) pairs where keys repeat; the result has the same type.
    """
    pairs = isinstance(updates.schema["tags"].dataType, T.ArrayType)
    keyed = updates.select(_key(updates).alias("key"), "recv_order", (F.col("op") == "set").alias("is_set"), "v_long", "v_double", "v_string")
    states = session.materialize(keyed.mapInArrow(_reduced, _STATE))
    every = W.partitionBy("key")
    states = states.withColumn("last_set", F.max("set_at").over(every))
    owns = F.col("set_at").eqNullSafe(F.col("last_set"))
    apart = ~owns & (F.col("first_add") < F.col("last_set")) & (F.col("last_add") > F.col("last_set"))
    counts = owns | (F.col("first_add") > F.col("last_set"))
    # Rows of one arrival position, which a feed does not have, are taken as one update each.
    merged = states.groupBy("key").agg(
        F.max("last_set").alias("set_at"), *[F.max_by(f"set_{v}", "set_at").alias(f"set_{v}") for v in ("long", "double", "string")],
        F.sum(F.when(counts, F.col("add_long"))).alias("add_long"), F.sum(F.when(counts, F.col("add_double"))).alias("add_double"),
        F.max("last_add").alias("last_add"), F.coalesce(F.bool_or(apart), F.lit(False)).alias("apart"),
    )
    merged = session.materialize(merged)
    on_text = F.col("set_string").isNotNull() & (F.col("last_add") > F.col("set_at"))
    again = F.col("apart") & ~on_text
    need = merged.agg(F.count_if(again), F.count_if(on_text)).first()

    adds = keyed.filter("not is_set")
    state = merged.withColumn("appended", F.lit(None).cast("string"))
    long, double = F.col("add_long"), F.col("add_double")
    if need[0]:
        after = _adds_after(adds, merged.filter(again)).groupBy("key").agg(
            F.sum("v_long").alias("after_long"), F.sum("v_double").alias("after_double")
        )
        state = state.join(after, "key", "left")
        long, double = F.when(again, F.col("after_long")).otherwise(long), F.when(again, F.col("after_double")).otherwise(double)
    if need[1]:
        # The result of such a group is the text of all its adds, so its size is the size of the result.
        said = F.coalesce(F.col("v_long").cast("string"), fixed6(F.col("v_double")))
        after = _adds_after(adds, merged.filter(on_text)).withColumn("text", said)
        number = after.groupBy("key").agg(F.count("*").alias("n"))
        most = number.agg(F.max("n")).first()[0]
        if most and most > MAX_APPENDED:
            raise ValueError(f"{most} numbers are added to one text; more than {MAX_APPENDED} are not supported")
        texts = after.groupBy("key", "set_string").agg(F.array_sort(F.collect_list(F.struct("recv_order", "text"))).alias("texts"))
        appended = F.aggregate("texts", F.col("set_string"), lambda text, x: F.concat(csv_text(text), x["text"]))
        state = state.drop("appended").join(texts.select("key", appended.alias("appended")), "key", "left")

    is_text = F.col("set_string").isNotNull()
    is_double = ~is_text & (F.col("set_double").isNotNull() | double.isNotNull())
    zero = F.lit(0).cast("bigint")
    total = F.coalesce("set_long", zero) + F.coalesce(long, zero)
    known = F.from_json("key", _KEY)
    return state.select(
        known["measurement"].alias("measurement"), (known["tags"] if pairs else F.map_from_entries(known["tags"])).alias("tags"),
        known["bucket_ts"].alias("bucket_ts"),
        known["field"].alias("field"),
        F.when(~is_text & ~is_double, total).alias("v_long"),
        F.when(is_double, F.coalesce("set_double", F.lit(0.0)) + F.coalesce(double, F.lit(0.0)) + total).alias("v_double"),
        F.when(is_text, F.coalesce("appended", "set_string")).alias("v_string"),
    )


def _key(updates: DataFrame) -> Column:
    """The group of an update as one text; tags in canonical order, so that the same pairs in another order are one group."""
    return F.to_json(F.struct("measurement", tag_pairs(updates).alias("tags"), "bucket_ts", "field"))


def tag_pairs(rows: DataFrame) -> Column:
    """The column ``tags``, a MAP or an ARRAY of pairs, as pairs in order of key and value; a repeated key keeps all its values."""
    if isinstance(rows.schema["tags"].dataType, T.MapType):
        return F.array_sort(F.map_entries("tags"))
    return F.array_sort(F.transform("tags", lambda pair: F.struct(pair["key"].alias("key"), pair["value"].alias("value"))))


@dataclass
class _State:
    """What some updates of a group come to: the last set, and the adds after it (all of them without a set)."""

    set_at: int | None
    sets: tuple
    add_long: int | None
    add_double: float | None
    first_add: int | None
    last_add: int | None

    def with_adds_of(self, other: _State) -> _State:
        if other.first_add is None:
            return self
        if self.first_add is None:
            return _State(self.set_at, self.sets, other.add_long, other.add_double, other.first_add, other.last_add)
        both = lambda a, b: b if a is None else a if b is None else a + b
        return _State(
            self.set_at, self.sets, both(self.add_long, other.add_long), both(self.add_double, other.add_double),
            min(self.first_add, other.first_add), max(self.last_add, other.last_add),
        )


def combined(one: _State, two: _State) -> _State | None:
    """One state for both, in either order; None if the later set lies among the other's adds."""
    if one.set_at is None or two.set_at is not None and two.set_at > one.set_at:
        one, two = two, one
    last = one.set_at
    if last is None or two.first_add is None or two.first_add > last:
        return one.with_adds_of(two)
    return one if two.last_add < last else None


def _batch_states(batch: pa.RecordBatch) -> Iterator[tuple[str, _State]]:
    """One state per group of a batch of updates."""
    coded = batch.column("key").dictionary_encode()
    codes = coded.indices.to_numpy()
    order = batch.column("recv_order").to_numpy(zero_copy_only=False)
    by = np.lexsort((order, codes))
    codes, order = codes[by], order[by]
    is_set = batch.column("is_set").to_numpy(zero_copy_only=False)[by]
    long, double, string = (batch.column(c) for c in ("v_long", "v_double", "v_string"))
    has_long, has_double = (c.is_valid().to_numpy(zero_copy_only=False)[by] for c in (long, double))
    longs, doubles = pc.fill_null(long, 0).to_numpy()[by], pc.fill_null(double, 0.0).to_numpy()[by]
    borders = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
    places = np.arange(len(codes))
    last_set = np.maximum.reduceat(np.where(is_set, places, -1), borders)
    sizes = np.diff(np.append(borders, len(codes)))
    counted = ~is_set & (places > np.repeat(last_set, sizes))
    with_long, with_double = counted & has_long, counted & has_double
    near = np.add.reduceat(np.where(with_long, longs.astype(float), 0.0), borders)
    if (np.abs(near) > 9e18).any():
        raise OverflowError("a sum of whole numbers does not fit into a BIGINT")
    sums = np.add.reduceat(np.where(with_long, longs, 0), borders).tolist()
    totals = np.add.reduceat(np.where(with_double, doubles, 0.0), borders).tolist()
    any_long, any_double, any_add = (np.logical_or.reduceat(w, borders).tolist() for w in (with_long, with_double, counted))
    first = np.minimum.reduceat(np.where(counted, order, np.iinfo(np.int64).max), borders).tolist()
    last = np.maximum.reduceat(np.where(counted, order, np.iinfo(np.int64).min), borders).tolist()
    names = coded.dictionary
    for i, at in enumerate(last_set.tolist()):
        row = int(by[at])
        sets = (long[row].as_py(), double[row].as_py(), string[row].as_py()) if at >= 0 else (None, None, None)
        yield names[int(codes[borders[i]])].as_py(), _State(
            int(order[at]) if at >= 0 else None, sets, sums[i] if any_long[i] else None, totals[i] if any_double[i] else None,
            first[i] if any_add[i] else None, last[i] if any_add[i] else None,
        )


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, _State] = {}
    apart: list[tuple[str, _State]] = []

    def given() -> pa.RecordBatch:
        rows = [*held.items(), *apart]
        held.clear()
        apart.clear()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        cells = [(k, s.set_at, *s.sets, s.add_long, s.add_double, s.first_add, s.last_add) for k, s in rows]
        columns = list(zip(*cells)) if cells else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in _STATE.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        for key, state in _batch_states(batch):
            before = held.get(key)
            both = state if before is None else combined(before, state)
            if both is None:
                apart.append((key, before))
                both = state
            held[key] = both
        if len(held) + len(apart) > HELD:
            yield given()
    yield given()


def _adds_after(adds: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds that arrive after the last set of their group, for the given groups only."""
    wanted = groups.select("key", "set_at", "set_string")
    if session.is_small(wanted):
        wanted = F.broadcast(wanted)
    return adds.drop("v_string").join(wanted, "key").filter(F.col("recv_order") > F.col("set_at"))


def value_text() -> Column:
    """CSV text of a long-form value."""
    return F.coalesce(F.col("v_long").cast("string"), fixed6(F.col("v_double")), F.col("v_string"))


def metric_keys(values: DataFrame) -> DataFrame:
    """Names of all tags and fields in use."""
    tags = values.select("measurement", F.lit("tag").alias("kind"), F.explode(F.map_keys("tags")).alias("name"))
    fields = values.select("measurement", F.lit("field").alias("kind"), F.col("field").alias("name"))
    return tags.unionByName(fields).distinct()


def pivot_fields(values: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One column per field name with the value's text, fields in name order.

    Without ``fields`` the names are looked up first; Spark stops at ``spark.sql.pivotMaxValues`` names.
    """
    keyed = values.select(
        "measurement", F.array_sort(F.map_entries("tags")).alias("_tags"), "bucket_ts", "field", value_text().alias("text")
    )
    groups = keyed.groupBy("measurement", "_tags", "bucket_ts")
    pivoted = groups.pivot("field", sorted(fields)) if fields else groups.pivot("field")
    wide = pivoted.agg(F.first("text", ignorenulls=True))
    return wide.withColumn("_tags", F.map_from_entries("_tags")).withColumnRenamed("_tags", "tags")
