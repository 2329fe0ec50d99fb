"""Exact top-k search by histogram selection.

Every candidate is scored against every query, in blocks of queries small enough to be sent to all tasks. Nothing is sorted:
each task counts its scores into a histogram per query, the histograms are added up, and the bin that holds the k-th score
becomes the next range, until the range is one score. Among rows with just that score the same is done over their ids. Then
one pass emits the rows at or above the k-th, k for each query, which are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Queries sent to all tasks at a time, bins of a histogram, queries in a row of packed counts.
QUERY_BLOCK = 4096
BINS = 128
COUNT_ROW = 64
# Scores a task holds at a time.
SCORES = 1 << 21
# Components beyond this range would make scores that are no longer exact.
LARGEST = 1 << 31


def integers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id, v``: vectors as integers ``floor(scale * x)``; rows with a null id, vector or component, or one that is not finite or
    too large, are left out."""
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    fit = F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < F.lit(float(LARGEST)))
    )
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return rows.filter(fit).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def top_k(
    vectors: DataFrame, is_query: str, k: int, scale: int = 64, key: str = "vec_id", vector: str = "embedding",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products of each row for which ``is_query`` holds.

    ``is_query`` is SQL text on the key. A query does not meet rows of its own key; it meets all others, repeated rows one by
    one; repeated query rows of the same key and vector are asked once, and of the same key and different vectors are told
    apart only by their scores. Ties go to the smaller key. Vectors meet those of their own length only. Rows that
    :func:`integers` leaves out take no part. An empty table gives an empty one.
    """
    rows = integers(vectors, key, vector, scale)
    spark = vectors.sparkSession
    asked = vectors.filter(is_query).transform(integers, key, vector, scale).distinct()
    shape = rows.agg(
        F.min("id").alias("first"), F.max("id").alias("last"),
        F.max(F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x * x).cast("decimal(38,0)"))).alias("norm"),
    ).first()
    blocks = -(-asked.count() // query_block)
    out, searches = None, 0
    for block in range(blocks):
        queries = asked.filter(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == block) if blocks > 1 else asked
        for ids, matrix in _by_length(queries.toArrow()):
            # Places of queries count from 0 in each search, so a query is known by both.
            part = _search(rows, spark.sparkContext.broadcast((ids, matrix)), len(ids), k, shape).withColumn("search", F.lit(searches))
            searches += 1
            out = part if out is None else out.unionAll(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    by_query = W.partitionBy("query_id", "search", "query").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _by_length(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    ids = table.column("id").to_numpy()
    vectors = table.column("v").to_pylist()
    lengths = np.array([len(v) for v in vectors])
    found = []
    for n in np.unique(lengths):
        take = np.flatnonzero(lengths == n)
        take = take[np.argsort(ids[take], kind="stable")]
        found.append((ids[take], np.array([vectors[i] for i in take], dtype=np.int64).reshape(len(take), n)))
    return found


def scored(ids: np.ndarray, queries: np.ndarray, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Scores, a row per candidate and a column per query, and the candidates' ids, in parts of bounded size."""
    vectors = batch.column("v")
    lengths = vectors.value_lengths().to_numpy()
    fit = np.flatnonzero(lengths == queries.shape[1])
    flat = vectors.filter(pa.array(lengths == queries.shape[1])).flatten().to_numpy().reshape(len(fit), queries.shape[1])
    found = batch.column("id").to_numpy()[fit]
    if not len(fit):
        return
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(flat).max(initial=0)) * queries.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object if most >= 1 << 63 else np.int64
    asked, step = queries.T.astype(kind), max(1, SCORES // len(ids))
    for at in range(0, len(fit), step):
        scores = flat[at : at + step].astype(kind) @ asked
        if kind is object:  # beyond the range of a long, the nearest long
            scores = np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64)
        yield scores, found[at : at + step]


def _search(rows: DataFrame, queries, n: int, k: int, shape) -> DataFrame:
    """``query, query_id, vec_id, score``: ``k`` rows for each query, and repeated rows of the last one."""
    bound = min(int(shape.norm) + 1, (1 << 63) - 1)
    context = rows.sparkSession.sparkContext
    # For each query: the range that holds the k-th largest value, and how many values are above it.
    kth, above, at_kth = _narrow(rows, queries, k, np.full(n, -bound), np.full(n, bound), None)
    tied = above + at_kth > k
    lowest = np.full(n, -shape.last, np.int64)
    highest = np.where(tied, -shape.first, lowest)
    last, _, _ = _narrow(rows, queries, k - above, lowest, highest, context.broadcast(kth))
    limits = context.broadcast((kth, -last))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = queries.value
        kth, last = limits.value
        for batch in batches:
            for scores, found in scored(ids, matrix, batch):
                at, query = np.nonzero(scores >= kth)
                score, vec = scores[at, query].astype(np.int64), found[at]
                good = (vec != ids[query]) & ((score > kth[query]) | (vec <= last[query]))
                at, query, score, vec = at[good], query[good], score[good], vec[good]
                yield pa.record_batch([pa.array(query, pa.int32()), pa.array(ids[query]), pa.array(vec), pa.array(score)], NAMES)

    return rows.mapInArrow(emit, "query int, query_id long, vec_id long, score long")


NAMES = ["query", "query_id", "vec_id", "score"]


def _narrow(rows, queries, wanted, low, high, level):
    """Shrink each query's range of values to the one value that has ``wanted`` rows at or above it, or to its lowest value.

    Values are scores, or with ``level`` the negated ids of the rows whose score is just that. Returns the value, the number of
    rows above it, and at it.
    """
    above, inside = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
    context = rows.sparkSession.sparkContext
    wanted, rounds = np.broadcast_to(wanted, low.shape), 0
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low, above, inside
        width = np.array([-((int(low[i]) - int(high[i]) - 1) // BINS) for i in range(len(low))], dtype=np.int64)
        counts = _histograms(rows, queries, context.broadcast((low, high, width, open_)), level, len(low), rounds)
        rounds += 1
        from_top = np.cumsum(counts[:, ::-1], axis=1)
        reached = from_top + above[:, None] >= wanted[:, None]
        for i in open_:
            place = int(np.argmax(reached[i])) if reached[i].any() else BINS - 1
            above[i] += int(from_top[i, place - 1]) if place else 0
            inside[i] = counts[i, BINS - 1 - place]
            start = int(low[i]) + (BINS - 1 - place) * int(width[i])
            low[i], high[i] = start, min(int(high[i]), start + int(width[i]) - 1)
            if start > high[i]:
                low[i] = high[i]


def _histograms(rows: DataFrame, queries, ranges, level, n: int, rounds: int) -> np.ndarray:
    """Counts of values by query and bin, added up over all tasks; packed rows of ``COUNT_ROW`` queries are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = queries.value
        low, high, width, open_ = ranges.value
        matrix, own = matrix[open_], ids[open_]
        low, high, width = low[open_], high[open_], width[open_]
        kth = None if level is None else level.value[open_]
        counts, columns = np.zeros(len(open_) * BINS, np.int64), np.arange(len(open_)) * BINS
        # The first round of scores takes all; later ones only what lies in the ranges.
        whole = kth is None and rounds == 0 and np.abs(low).max() < 1 << 52
        for batch in batches:
            for scores, found in scored(own, matrix, batch):
                if whole:
                    bins = np.floor((scores.astype(np.float64) - low) / width).astype(np.int64) + columns
                    counts += np.bincount(bins.ravel(), minlength=len(counts))
                    mine = np.flatnonzero(np.isin(found, own))
                    at, query = np.nonzero(found[mine, None] == own)
                    np.subtract.at(counts, bins[mine[at], query], 1)
                    continue
                if kth is None:
                    at, query = np.nonzero((scores >= low) & (scores <= high))
                    value = scores[at, query].astype(np.int64)
                else:
                    at, query = np.nonzero(scores == kth)
                    value = -found[at]
                good = (found[at] != own[query]) & (value >= low[query]) & (value <= high[query])
                query, value = query[good], value[good]
                bins = (value - low[query]) // width[query]
                counts += np.bincount(query * BINS + bins, minlength=len(counts))
        packed = [counts[i : i + COUNT_ROW * BINS].tobytes() for i in range(0, len(counts), COUNT_ROW * BINS)]
        yield pa.record_batch([pa.array(range(len(packed)), pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column("counts"):
                one = np.frombuffer(row.as_buffer(), np.int64)
                total = one.copy() if total is None else total + one
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    sums = rows.mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).toArrow()
    full = np.zeros((n, BINS), np.int64)
    open_ = ranges.value[3]
    for part, packed in zip(sums.column("part").to_pylist(), sums.column("counts").to_pylist()):
        take = open_[part * COUNT_ROW : (part + 1) * COUNT_ROW]
        full[take] = np.frombuffer(packed, np.int64).reshape(len(take), BINS)
    return full


SQL = """
with v as (
  select vec_id, [floor(64.0::double * x::double)::bigint for x in embedding] v from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), pairs as (
  select q.vec_id query_id, c.vec_id vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::integer rank from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
