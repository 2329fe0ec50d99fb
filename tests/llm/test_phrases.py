"""Phrase mining: the query against SQL, counts against a plain loop with spills and bursts forced, exact scores, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, database

from tickloom.llm import phrases
from tickloom.llm.queries import op12_phrases


def test_query(spark, sf_dir):
    assert compare(spark, database(sf_dir), sf_dir, "op12_phrases", op12_phrases, phrases.SQL) > 0


def plain_counts(rows, least, longest=5):
    found = {}
    for lang, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    found.setdefault(lang or "und", Counter())[" ".join(words[i : i + k])] += 1
    return {(lang, p, n) for lang, c in found.items() for p, n in c.items() if n >= least}


def texts(seed, rows=40):
    draw = random.Random(seed)
    words = ["a", "A", "b", "of", "the", "naïve", "x y", "語", "q r", "rare1", "rare2"]
    said = []
    for i in range(rows):
        size = draw.choice([0, 1, 30, 200])
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " !? "]) for _ in range(size))
        said.append((draw.choice(["en", "en", "fr", None]), text + " the end of it all of the end of it" * (i % 3)))
    return said


@pytest.mark.parametrize("entries,burst,words,bits", [(400_000, 16_384, 10**6, 1 << 27), (50, 5, 10**6, 1 << 15), (30, 3, 12, 1 << 15)])
def test_counts(spark, monkeypatch, entries, burst, words, bits):
    def count(lengths, seen, batches):
        return list(phrases._counted(lengths, seen)(batches))

    rows = texts(entries)

    class Shared:
        value = None

    monkeypatch.setattr(phrases, "CHUNK", 200)
    monkeypatch.setattr(phrases, "ENTRIES", entries)
    monkeypatch.setattr(phrases, "BURST", burst)
    monkeypatch.setattr(phrases, "WORDS", words)
    batch = pa.record_batch([pa.array([r[0] or "und" for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    found = Counter()
    for length in (1, 2, 3, (4, 5)):
        for run in count(length if isinstance(length, tuple) else (length,), None, [batch]):
            for g in run.to_pylist():
                if g["phrase"] is not None:
                    found[g["lang"], g["phrase"]] += g["f"]
    assert {(*k, n) for k, n in found.items()} == plain_counts(rows, 1)


def test_runs_are_shuffled_in_few_rows():
    rows = [(i * 7 % 5, "en", f"a w{i}", i) for i in range(10_000)]
    batch = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.string(), pa.string(), pa.int64()))], ["part", "lang", "phrase", "f"])
    total = pa.record_batch([pa.array([0], pa.int32()), pa.array(["en"]), pa.array([None], pa.string()), pa.array([9])], ["part", "lang", "phrase", "f"])
    packed, last = [b.to_pylist() for b in phrases._packed(iter([batch, total]))]
    assert len(packed) == 5 and last == [{"part": 0, "lang": "en", "phrases": None, "counts": [9]}]
    assert {(r["part"], r["lang"], p, f) for r in packed for p, f in zip(r["phrases"].split("\n"), r["counts"], strict=True)} == set(rows)


def test_parts_of_given_out_phrases_lie_together():
    draw = random.Random(4)
    text = " ".join(f"w{draw.randrange(3000)}" for _ in range(60_000))
    batch = pa.record_batch([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    rows = [r for b in phrases._packed(phrases._counted((2,), None)(iter([batch]))) for r in b.to_pylist()]
    pairs = Counter()
    for r in rows:
        for phrase, n in zip(r["phrases"].split("\n"), r["counts"], strict=True):
            pairs[phrase] += n
    words = text.split(" ")
    assert pairs == Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
    assert len(rows) < 1.05 * phrases.PARTS and len(pairs) > 50_000
    assert all(0 <= r["part"] < phrases.PARTS for r in rows)


@pytest.mark.parametrize("least", [2, 8])
def test_frequencies(spark, least):
    rows = texts(least, 80)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    every, totals = phrases.frequencies(docs, least=least)
    assert {(r.lang, r.phrase, r.f) for r in every.collect()} == plain_counts(rows, least)
    ones = plain_counts(rows, 1, 1)
    assert {r.lang: r.n for r in totals.collect()} == {lang: sum(n for at, _, n in ones if at == lang) for lang, _, _ in ones}


def test_bitmap_stops_no_frequent_phrase(spark):
    rows = [("en", f"w{i} v{i}"[: 2 + i % 7]) for i in range(3000)]
    frequent = spark.createDataFrame(rows, "lang string, phrase string")
    seen = phrases.Seen(phrases.bitmap(frequent))

    keys = np.array([phrases._phrase_key(lang, p.encode().split(b" ")) for lang, p in rows], np.uint64)
    assert seen.has(keys).all()
    others = np.array([phrases._word_key("en", b"other%d" % i) for i in range(2000)], np.uint64)
    assert seen.has(others).sum() < 20


def test_scores_are_exact(spark):
    a, n, left, right = 10**12 + 7, 10**13 + 1, 10**12 + 9, 2 * 10**12 + 3
    frequent = spark.createDataFrame(
        [("en", "x y", a, 2), ("en", "x", left, 1), ("en", "y", right, 1)], "lang string, phrase string, f long, words int"
    )
    (row,) = phrases.scored(frequent, spark.createDataFrame([("en", n)], "lang string, n long")).collect()
    assert row.score == 1000 * a * n // (left * right)


def test_ties_absorption_and_odd_rows(spark):
    rows = [(None, "a b c d e f. " * 3, 1), ("en", None, 2), ("en", "", 3), (None, "g h", 4), (None, "g h", 4), (None, "G\tH", 4)]
    docs = spark.createDataFrame(rows, "lang string, text string, n int")
    got = [tuple(r) for r in phrases.mined(docs, least=3).orderBy("rank").collect()]
    # phrases inside "a b c d e" and "b c d e f" are absorbed; equal scores go by phrase
    n = 24
    assert got == [
        ("und", 1, "a b c d e", 3, 3, 3, n, 8000), ("und", 2, "b c d e f", 3, 3, 3, n, 8000), ("und", 3, "g h", 3, 3, 3, n, 8000),
    ]
    assert phrases.mined(docs.limit(0), least=3).count() == 0
    assert phrases.mined(docs, least=3, report=1).count() == 1
