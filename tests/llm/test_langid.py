"""Language ID: sums over segmentations against enumeration, held-out accuracy, odd rows."""

import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest

from tickloom.llm import langid
from tickloom.llm.queries import PIECES, op1_langid

PATH = public_tokenizers.path(PIECES)


@pytest.fixture(scope="module")
def lattice():
    with open(PATH, "rb") as file:
        return langid.lattice_of(file.read())


def enumerated(lattice, logp, word):
    """All segmentations of a word, one by one: probability, and pieces."""
    edges, spelled = lattice.edges([word])
    by_start = {}
    for _, start, end, piece in edges.T:
        by_start.setdefault(start, []).append((end, [piece]))
    for at, group in itertools.groupby(spelled.T, key=lambda row: row[1]):
        by_start.setdefault(at, []).append((at + 1, [row[2] for row in group]))

    def ways(at):
        if at == len(word):
            yield []
        for end, pieces in by_start.get(at, []):
            for rest in ways(end):
                yield pieces + rest

    return [(math.exp(sum(logp[p] for p in pieces)), pieces) for pieces in ways(0)]


@pytest.mark.parametrize("word", ["a", "the", "schöner", "naïveté", "ħello", "漢字日", "ΑΒΓ"])
def test_sum_over_segmentations(lattice, word):
    draw = np.random.default_rng(4)
    logp = np.log(draw.dirichlet(np.ones(lattice.size), size=2).T)
    for one in range(2):
        ways = enumerated(lattice, logp[:, one], word)
        total = sum(p for p, _ in ways)
        got = langid.likelihoods(lattice, logp, ["other", word])[1, one]
        assert got == pytest.approx(math.log(total))
        want = np.zeros(lattice.size)
        for p, pieces in ways:
            np.add.at(want, pieces, 3 * p / total)
        counts = langid.expected(lattice, logp[:, one], ["xy", word], np.array([0, 3]))
        assert counts == pytest.approx(want)


def test_words_of_a_part_are_read_in_one_pass(lattice, monkeypatch):
    """A pass over the pieces for each word took most of the time."""
    words = ["a", "the", "thea", "athe", "schöner", "ħello", "漢字日", "thethethe"] * 3
    single = [lattice.edges([word]) for word in words]
    passes = []

    class Counted:
        def __init__(self, matcher):
            self.iter = lambda text: passes.append(text) or matcher.iter(text)

    monkeypatch.setattr(lattice, "matcher", Counted(lattice.matcher))
    edges, spelled = lattice.edges(words)
    assert len(passes) == 1
    for k in range(3):
        assert edges[k + 1].tolist() == [x for one, _ in single for x in one[k + 1]]
    assert edges[0].tolist() == [w for w, (one, _) in enumerate(single) for _ in one[0]]
    assert spelled.T.tolist() == [[w, at, b] for w, (_, one) in enumerate(single) for _, at, b in one.T.tolist()]
    assert lattice.edges([])[0].shape == (4, 0)


def test_held_out_accuracy(spark, sf_dir):
    rows = {r.doc_id: r for r in op1_langid(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    right = held = 0
    for d in docs:
        row = rows[d.doc_id]
        assert row.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1
        if row.held_out and d.lang and d.text:
            held += 1
            right += row.lang_pred == d.lang
    assert right >= 0.98 * held > 0


def test_odd_rows(spark):
    known = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 5)]
    odd = [(100, None, "en"), (101, "", None), (102, "12 34 !", "de"), (None, "the dog", None), (103, "x" * 300_000, None),
           (104, "the dog and der", None), (104, "the dog and der", None), (105, "und die " * 400_000, None)]
    docs = spark.createDataFrame(
        [(i, t, l, 1.0, 2) for i, t, l in known + odd], "doc_id long, text string, lang string, score double, _row int"
    )
    model = langid.train(docs, PATH)
    assert model.languages == ["de", "en"]
    rows = langid.predict(docs, model).collect()
    assert len(rows) == len(known) + len(odd)
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("de", "en") and 0.5 <= r.score <= 1
    assert {r.lang_pred for r in rows if r.doc_id == 105} == {"de"}
    nothing = langid.train(docs.limit(0), PATH)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0
