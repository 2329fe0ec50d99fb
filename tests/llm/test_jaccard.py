"""The Jaccard join against brute force, with families of near copies that go through both kinds of lists."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from tickloom.llm import jaccard
from tickloom.llm.queries import op3_jaccard

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_sets(rows):
    out = []
    for i, text in rows:
        words = WORD.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
        out.append((i, frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()))
    return out


def brute(rows):
    sets = shingle_sets(rows)
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for at, (i, s) in enumerate(sets):
        for token in s if i is not None else ():
            having[token].append(at)
    tried = {(a, b) for v in having.values() for a in v for b in v if a < b}
    for a, b in tried:
        (i, s), (j, t) = sets[a], sets[b]
        both = len(s & t)
        if 100 * both >= 75 * (len(s) + len(t) - both):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return sorted(((i is None, i or 0, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def result(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op3_jaccard(spark, sf_dir)) == brute(rows)


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        at = draw.randrange(len(words))
        words[at : at + draw.randrange(2)] = [draw.choice(["new", "other", "word"]) + str(draw.randrange(10**6))] * draw.randrange(2)
    return " ".join(words)


@pytest.mark.parametrize("short", [48, 4])
def test_families_and_odd_rows(spark, short):
    draw = random.Random(11)
    texts = []
    for size, copies in ((60, 120), (25, 90), (200, 30), (9, 40)):
        base = [f"w{draw.randrange(5000)}" for _ in range(size)]
        half = edited(draw, base, 3).split()
        for k in range(copies):
            texts.append(edited(draw, half if k % 2 else base, draw.randrange(1 + size // 12 + k % 3)))
    passage = "one passage of many words that is in a great many of the documents here"
    texts += [passage + " " + " ".join(f"x{draw.randrange(10**6)}" for _ in range(draw.randrange(40))) for _ in range(150)]
    texts += [None, "", " \n", "a", "A", "a b c", "a b  c", "a b c d e", "é b c d e", "É b c d e", "long text " * 50_000, passage, passage]
    draw.shuffle(texts)
    rows = [(i * 3 - 100, t) for i, t in enumerate(texts)] + [(None, passage), (-100, texts[0])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, d1 string").repartition(5)
    assert result(jaccard.groups(docs, short=short)) == brute(rows)


def test_pairs_of_lists_are_given_out_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS", 100)
    draw = random.Random(5)
    lists = [sorted(draw.sample(range(60), draw.choice([1, 2, 2, 3, 30, 40]))) for _ in range(80)]
    rank, sizes = np.array([i for one in lists for i in one]), np.array([len(one) for one in lists])
    starts = np.cumsum(sizes) - sizes
    ids = np.array([i * 3 - 70 for i in range(60)])
    parts = [(rank[a], rank[b]) for a, b in jaccard._places(starts, sizes)]
    assert max(len(a) for a, _ in parts) <= 40 * 39 // 2  # one list, or about PAIRS
    given = [part.to_pylist() for part in jaccard._distinct(0, ids, iter(parts))]
    assert len(given) > 1 and max(map(len, given)) <= 2 * 100 + 40 * 39 // 2
    want = {(ids[x], ids[y]) for one in lists for i, y in enumerate(one) for x in one[:i]}
    assert {(r["a"], r["b"]) for part in given for r in part} == want


def test_similar_sets_are_found_in_few_buckets(spark):
    draw = random.Random(8)
    texts = []
    for copies in (2, 2, 2, 2, 30):
        base = [f"w{draw.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(base + [f"end{k}"]) for k in range(copies)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard.scan(jaccard.index(docs, np.zeros(0, np.uint64), 50)).groupBy("kind").count().collect()
    found = {r["kind"]: r["count"] for r in rows}
    assert found[0] <= 3 * 4 and found[1] <= 3 * 30  # a pair or member was given by each of 50 buckets before


def test_large_groups_list_no_pairs(spark):
    draw = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(w if draw.random() < 0.97 else f"x{draw.randrange(10**6)}" for w in base) for _ in range(60)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = jaccard.scan(jaccard.index(docs, np.zeros(0, np.uint64), 8)).filter("kind = 0").count()
    assert scanned < 60 * 59 // 4  # nearly all pairs before
    assert result(jaccard.groups(docs)) == brute(rows)
    _, near = similar_sets(rows)
    assert jaccard.pairs(docs).count() == len(near)


def test_overlaps_and_forests(monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 4)
    draw = random.Random(1)
    sets = [set(draw.sample(range(50), draw.randrange(0, 30))) for _ in range(25)]
    shared = jaccard._overlaps([np.array(sorted(s), np.uint64) for s in sets])
    assert all(shared[i, j] == len(s & t) for i, s in enumerate(sets) for j, t in enumerate(sets) if i < j)
    assert (shared[np.triu_indices(25, 1)] == shared.T[np.triu_indices(25, 1)]).all()
    good = np.array([[len(s & t) > 11 for t in sets] for s in sets])
    a, b = jaccard._forest(good)
    assert 0 < len(a) < 25 and good[a, b].all()

    def reached(links):
        of = list(range(25))
        for x, y in links:
            of = [of[x] if o == of[y] else o for o in of]
        return {frozenset(i for i in range(25) if of[i] == o) for o in of}

    assert reached(zip(a.tolist(), b.tolist())) == reached(zip(*map(list, np.nonzero(good))))
    assert jaccard._overlaps([np.zeros(0, np.uint64)] * 2).tolist() == [[0, 0], [0, 0]]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.groups(docs).count() == 0


def test_drawing_from_very_large_families(spark):
    places = [0, 1 << 20, 1 << 39, (1 << 40) - 1]
    rows = spark.createDataFrame([(p, n) for p in places for n in (1, 100, 1 << 23, 1 << 33, 1 << 40)], "place long, n long")
    for r in rows.select("place", "n", jaccard.drawn_of(F.col("place"), F.col("n")).alias("drawn")).collect():
        assert r.drawn == (r.place < (jaccard.SAMPLE << 40) // r.n)


def similar_sets(rows):
    """Keys of every set, and the pairs of similar different ones."""
    keys = defaultdict(list)
    for i, s in shingle_sets(rows):
        if i is not None and s:
            keys[s].append(i)
    sets = list(keys)
    pairs = [(s, t) for k, s in enumerate(sets) for t in sets[:k] if 100 * len(s & t) >= 75 * len(s | t)]
    return keys, pairs


def test_all_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    short = 48
    draw = random.Random(3)
    texts = [None, "", "a b c", "A  b c"]
    for size, copies in ((60, 110), (200, 130), (9, 30)):
        base = [f"w{draw.randrange(5000)}" for _ in range(size)]
        half = edited(draw, base, 3).split()
        for k in range(copies):
            texts.append(edited(draw, half if k % 2 else base, draw.randrange(2 + size // 50 + k % 2)))
    draw.shuffle(texts)
    rows = [(i * 3 - 100, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keys, near = similar_sets(rows)
    want = sorted(tuple(sorted((min(keys[s]), min(keys[t])))) for s, t in near)
    got = sorted((r.a, r.b) for r in jaccard.pairs(docs, short=short).collect())
    assert got == want and len(want) > 2000
    counts = defaultdict(int)
    for s, t in near:
        for i in keys[s] + keys[t]:
            counts[i] += 1
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_links) for r in jaccard.link_counts(docs, short=short).collect())
    assert found == sorted((i is None, i or 0, None if i is None else counts[i]) for i, _ in rows)


def test_index_rows_are_given_out_some_at_a_time():
    """All rows of a task at once are some copies of all its entries."""
    draw = np.random.default_rng(1)
    entries = np.zeros(400_000, jaccard.ENTRY)
    entries["token"] = draw.integers(0, 1 << 63, len(entries))
    entries["id"] = np.arange(len(entries)) // 100
    parts = np.array_split(entries, 7)
    batches = list(jaccard._index_rows(parts, 50))
    assert not parts and len(batches) > 1
    rows = [(r["bucket"], np.frombuffer(r["entries"], jaccard.ENTRY)) for batch in batches for r in batch.to_pylist()]
    assert max(batch.nbytes for batch in batches) < 2 * jaccard.PART_BYTES
    assert [b for b, _ in rows] == list(range(50)) and all((own["token"] % 50 == b).all() for b, own in rows)
    assert np.array_equal(np.sort(np.concatenate([own for _, own in rows])), np.sort(entries))
