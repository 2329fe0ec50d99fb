"""Top-k by histogram selection against brute force: ties, repeated rows, odd vectors, blocks of queries."""

import math
import random

from oracle import compare, database

from tickloom.llm import topk
from tickloom.llm.queries import op4_topk


def brute(rows, is_query, k):
    good = [
        (i, [math.floor(64 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if is_query(i)}:
        found = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(b) == len(a))[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found)]
    return sorted(out)


def test_query(spark, sf_dir):
    assert compare(spark, database(sf_dir), sf_dir, "op4_topk", op4_topk, topk.SQL) > 0


def test_ties_repeats_and_odd_rows(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25]) for _ in range(3)]) for i in range(300)]
    rows += [(1000 + i, [0.25, 0.25, 0.25]) for i in range(200)]  # more ties than k
    rows += [(7, [0.25, 0.25, 0.25]), (7, [0.25, 0.25, 0.25]), (9, [0.5, 0.5, 0.5]), (9, [0.5, 0.5, 0.5])]
    rows += [(None, [1.0, 1.0, 1.0]), (2000, None), (2001, [1.0, None, 1.0]), (2002, [1.0, math.nan, 1.0]), (2003, [math.inf, 0.0, 0.0])]
    rows += [(2010, [1.0]), (2020, [1.0]), (2030, [])]
    table = [(i, v, i, 1.0) for i, v in rows]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, id long, score double")
    for block in (4096, 16):
        got = topk.top_k(df, "vec_id % 10 = 0", 5, query_block=block)
        assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0, 5)
    assert topk.top_k(df.limit(0), "vec_id % 10 = 0", 5).count() == 0


def test_fewer_candidates_than_k_and_large_numbers(spark):
    rows = [(0, [1e7, 3.0]), (1, [-1e7, 2.0]), (2, [1e7, 1.0]), (-5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, "vec_id % 2 = 0", 20).collect()))
    assert got == brute(rows, lambda i: i % 2 == 0, 20)


def test_one_id_with_several_vectors_does_not_depend_on_the_block(spark):
    draw = random.Random(5)
    rows = [(i, [draw.random(), draw.random()]) for i in range(1, 31)] + [(i, [draw.random()]) for i in range(31, 61)]
    rows += [(100, [0.5, 0.25]), (100, [0.125, 1.0]), (100, [0.75]), (200, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, lambda i: i >= 100, 20)
    assert len(want) == 80
    for block in (4096, 2, 1):
        assert sorted(map(tuple, topk.top_k(df, "vec_id >= 100", 20, query_block=block).collect())) == want
