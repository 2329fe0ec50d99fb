"""Line dedup against SQL and brute force: edits of one word, short lines, places, odd rows."""

import random

import numpy as np
import pyarrow as pa
from oracle import compare, database

from tickloom.llm import lines, shingles
from tickloom.llm.held import _held, held
from tickloom.llm.queries import SQL, op6_lines


def test_tasks_drop_models_of_earlier_stages_and_take_texts_in_parts(monkeypatch):
    monkeypatch.setattr(lines, "PART", 20)
    texts = [None, "", "a b\nc", "x" * 50 + "\ny", "a\n\nb"] * 3
    gone = [None, [], [0], [1], None] * 3
    assert held("a model", lambda: 1) == 1
    kept = lines._keep(pa.array(texts), pa.array(gone, pa.list_(pa.int32())))
    assert not _held
    assert kept.to_pylist() == [
        {"text": t, "n_lines": n, "n_kept": k} for t, n, k in ((None, 0, 0), ("", 0, 0), ("c", 2, 1), ("x" * 50, 2, 1), ("a\n\nb", 2, 2))
    ] * 3
    assert lines._keep(pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))).to_pylist() == []
    parts = [p.column(0).to_pylist() for p in shingles.in_parts([pa.record_batch([pa.array(texts)], ["t"])], "t", 20)]
    assert sum(parts, []) == texts and all(len(p) == 1 or sum(len(t or "") for t in p) <= 20 for p in parts)


def test_lines_are_taken_out_once_if_counts_are_filtered(spark):
    docs = spark.createDataFrame([(i, f"line {i % 3}\nown line {i}") for i in range(9)], "doc_id long, text string")
    rows = lines.dedup(docs).filter("n_kept > 0 or n_lines = 0").select("doc_id", "text")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_keep(") == 1, plan
    assert rows.count() == 9


def test_texts_and_lines_are_hashed_together(monkeypatch):
    draw, calls, words = random.Random(9), [], shingles.words
    monkeypatch.setattr(shingles, "words", lambda *a, **k: calls.append(a) or words(*a, **k))
    texts = [b"", b" ", b"\n", b"\n\na b\n", b"x" * 70_000 + b" y"] + [
        "".join(draw.choice(["a", "b", " ", "\t", "\n", "é", "\u2003"]) for _ in range(draw.randrange(60))).encode() for _ in range(200)
    ]
    place, *found = lines.keys_of_all(texts)
    assert len(calls) == 1
    for k, text in enumerate(texts):
        assert all(np.array_equal(a[place == k], b) for a, b in zip(found, lines.keys_of(text)))
    assert [len(run) for run in lines._joined([b"a" * lines.JOINED, b"b", b"", b"c" * lines.JOINED])] == [1, 2, 1]

    every = [line for text in texts for line in text.split(b"\n")]
    own = [shingles._mixed(lines._sums(words(line, fold=False)[0])[-1:]).astype(np.int64)[0] for line in every]
    own[-1] += 1  # a line that is not the one its hash is of
    ids = pa.array(range(len(every)))
    batch = pa.record_batch([pa.array(own), ids, ids.cast(pa.int32())], ["h", "doc", "line"])
    calls.clear()
    rows = [row for part in lines._rows(batch, every) for row in part.to_pylist()]
    assert len(calls) == 1
    want = []
    for i, line in enumerate(every[:-1]):
        parts = line.split()
        for at in range(-1, len(parts)):
            kept = b" ".join(parts[:at] + parts[at + 1 :] if at >= 0 else parts)
            key = int(shingles._mixed(lines._sums(words(kept, fold=False)[0])[-1:]).astype(np.int64)[0])
            want.append({"h": own[i], "doc": i, "line": i, "key": key, "place": at})
    assert rows == want


def apart(a, b):
    """Whether two word lists are at most one edit apart, by the table of distances."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, before = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
    return row[-1] <= 1


def brute(rows):
    every = [((i, at), part.encode().split()) for i, t in rows if i is not None for at, part in enumerate((t or "").split("\n"))]
    every = [(place, words) for place, words in every if words]
    gone = set()
    for place, words in every:
        for other, before in every:
            if other < place and abs(len(words) - len(before)) < 2 and (words == before or min(len(words), len(before)) >= lines.MIN_WORDS and apart(words, before)):
                gone.add(place)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        n = sum(1 for p in parts if p.encode().split())
        kept = [p for at, p in enumerate(parts) if i is None or (i, at) not in gone]
        out.append((i, None if t is None else "\n".join(kept), n, n - (len(parts) - len(kept))))
    return sorted(out, key=repr)


def test_query(spark, sf_dir):
    assert compare(spark, database(sf_dir), sf_dir, "op6_lines", op6_lines, SQL["op6_lines"]) > 0


def test_edits_and_odd_rows(spark):
    draw = random.Random(2)
    bases = [[f"w{draw.randrange(30)}" for _ in range(n)] for n in (3, 7, 8, 8, 9, 9, 15)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(draw.randint(1, 4)):
            words = list(draw.choice(bases))
            for _ in range(draw.choice([0, 1, 1, 2])):
                at = draw.randrange(len(words))
                words[at : at + draw.randrange(2)] = [draw.choice(["w1", "w2", "new"])] * draw.randrange(2)
            parts.append(draw.choice([" ", "\t"]).join(words))
            parts += [""] * draw.randrange(2)
        texts.append("\n".join(parts))
    texts += [None, "", "\n\n", " \n x", "x", "a " * 900, "a " * 899 + "b", "long " * 30_000, "a b c d e f g h", "b c d e f g h a"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (5, texts[5])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, h string, n_kept int").repartition(3)
    out = lines.dedup(docs)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_kept) for r in out.collect()), key=repr) == brute(rows)
    assert out.columns == ["doc_id", "text", "h", "n_kept", "n_lines"]
    assert lines.dedup(docs.limit(0)).count() == 0
