"""Chat rotation and spot signatures: the queries against SQL, and odd rows against plain versions."""

import random
import re

import pytest
from oracle import compare, database

from tickloom.llm import chat, spotsigs
from tickloom.llm.queries import QUERIES, SQL


def test_queries(spark, sf_dir):
    con = database(sf_dir)
    for name in ("op8_chat", "op10_spotsigs"):
        assert compare(spark, con, sf_dir, name, QUERIES[name], SQL[name]) > 0


def test_rotation(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "<|im_end|> hé"), (1, 3, "", None), (1, 3, None, "x"),
        (1, 2, "bob", "<|im_end|> hé"), (2, 0, "system", "alone"), (None, None, "ann", "q"), (None, 1, "bob", "r" * 100_000), (3, 5, "cy", ""),
    ]
    turns = spark.createDataFrame([(*r, 1, "s") for r in rows], "conv_id long, turn long, role string, text string, seg_start int, speaker string")
    got = chat.rotate(turns.repartition(4)).collect()
    want = {}
    for conv in {r[0] for r in rows}:
        own = [(r[1], r[2] or "unknown", (r[3] or "").replace("<|im_", "<| im_")) for r in rows if r[0] == conv]
        own.sort(key=lambda t: (t[0] is not None, t))
        for speaker in {n for _, n, _ in own} - {"system"}:
            whole = ""
            for turn, name, text in own:
                head = "<|im_start|>" + ("system" if name == "system" else "assistant" if name == speaker else f"user name={name}") + "\n"
                mask = (len(whole) + len(head), len(whole) + len(head + text) + len("<|im_end|>")) if name == speaker else (None, None)
                part = head + text + "<|im_end|>\n"
                want.setdefault((conv, speaker), []).append((turn, part, len(whole), len(whole + part), *mask))
                whole += part
    found = {}
    for r in got:
        found.setdefault((r.conv_id, r.speaker), []).append((r.turn, r.segment, r.seg_start, r.seg_end, r.mask_start, r.mask_end))
    assert {k: sorted(v, key=lambda x: x[2]) for k, v in found.items()} == want
    assert chat.rotate(turns.limit(0)).count() == 0


def plain(text):
    words = re.sub(r"[\W_]+", " ", "".join(c.lower() if c < "\x7f" else c for c in text)).split()
    out = set()
    for i, w in enumerate(words):
        chain, at = [w], i + 1
        while w in spotsigs.ANCHORS and len(chain) < 3:
            passed = 0
            while at < len(words) and words[at] in spotsigs.ANCHORS:
                at, passed = at + 1, passed + 1
            if at == len(words) or passed > spotsigs.PASSED:
                break
            chain.append(words[at])
            at += 1
        if len(chain) == 3:
            out.add(tuple(chain))
    return out or {tuple(words), ("alone",)}


def test_fingerprints(spark):
    texts = ["the big dog and a cat of the house", "The BIG dog, and a cat of (the) house", "no common words", None, "", "the", "the " * 40 + "x y",
             "a quick fox in the wild wood " * 3000, "la maison et le grand jardin vert", "12 is the number of things"]
    rows = [(i * 10**12, t) for i, t in enumerate(texts)] + [(None, "is it here or there"), (0, texts[0]), (0, "is a second text")]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, fingerprint string, n_chars int")
    got = spotsigs.edited_pairs(docs).collect()
    assert len(got) == len(rows)
    order = sorted(((i if i is not None else -(1 << 62)), t or "") for i, t in rows)
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        part = len(t) // 4
        edited = t[: len(t) - part] + nxt[:part]
        a, b, c = plain(t), plain(edited), plain(nxt)
        same = lambda x, y: 1.0 if x == y else len(x & y - {("alone",)}) / len((x | y) - {("alone",)})
        want.append((i, len(t), edited, round(same(a, b), 9), round(same(a, c), 9)))
    found = [(-(1 << 62) if r.doc_id is None else r.doc_id, r.n_chars, r.edited, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(found) == sorted(want)
    assert len({r.fingerprint for r in got if r.n_chars and r.edited is not None and r.doc_id in (0, 10**12)}) == 2
    assert spotsigs.edited_pairs(docs.limit(0)).count() == 0


def whole(text):
    """The set of signatures, any number of anchors passed over."""
    words = re.sub(r"[\W_]+", " ", "".join(c.lower() if c < "\x7f" else c for c in text or "")).split()
    content = [(i, w) for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    out = set()
    for i, w in enumerate(words):
        after = [c for j, c in content if j > i][:2]
        if w in spotsigs.ANCHORS and len(after) == 2:
            out.add((w, *after))
    return frozenset(out or {(*words, "alone")})


@pytest.mark.parametrize("at_least", [0.5, 0.8, 1.0, 0.07])
def test_near_pairs(spark, at_least):
    draw = random.Random(5)
    texts = []
    for size in (12, 60, 300, 40):
        base = [draw.choice(["the", "a", "of", f"w{draw.randrange(400)}"]) for _ in range(size)]
        for k in range(25):
            words = list(base)
            for _ in range(draw.randrange(1 + size // 6)):
                words[draw.randrange(len(words))] = f"n{draw.randrange(400)}"
            texts.append(" ".join(words[: max(3, size - draw.randrange(1 + size // 3))]))
    run = "the " * 9
    texts += [None, "", "no anchors", "No anchors!", texts[0], texts[0].upper(), f"{run}big {run}house {run}stands alone", "the big house stands alone", "the " * 50_000 + "end of it all"]
    draw.shuffle(texts)
    rows = [(7 * i - 50, t) for i, t in enumerate(texts)] + [(None, texts[0]), (-50, texts[0]), (-50, "of one other text")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, near string, n int").repartition(4)
    got = sorted((r.a, r.b, round(r.near, 9)) for r in spotsigs.near_pairs(docs, at_least).collect())
    classes = {}
    for i, t in rows:
        if i is not None:
            classes.setdefault(whole(t), set()).add(i)
    want = [(min(c), i, 1.0) for c in classes.values() for i in c if i != min(c)]
    sets = list(classes.items())
    for k, (s, c) in enumerate(sets):
        for t, d in sets[:k]:
            near = len(s & t) / len(s | t)
            if near >= at_least:
                want.append((min(min(c), min(d)), max(min(c), min(d)), round(near, 9)))
    assert got == sorted(want) and any(abs(texts.index(texts[0]) - (b + 50) // 7) > 1 for _, b, _ in got)
    assert spotsigs.near_pairs(docs.limit(0), at_least).count() == 0


def test_pairs_query(spark, sf_dir):
    assert compare(spark, database(sf_dir), sf_dir, "op10_pairs", QUERIES["op10_pairs"], SQL["op10_pairs"]) > 0
