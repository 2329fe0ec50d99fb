"""Conversation repair: the query against SQL, the agenda against all edit sequences, long conversations in parts, odd rows."""

import hashlib
import itertools
import random
import re

import pytest
from oracle import compare, database

from tickloom.llm import convrepair
from tickloom.llm.queries import op13_repair


def test_query(spark, sf_dir):
    assert compare(spark, database(sf_dir), sf_dir, "op13_repair", op13_repair, convrepair.SQL) > 0


def plain(rows):
    """The cheapest edits by trying all of them, with up to two insertions at each place."""
    best = None
    choices = [[(2, "D", None)] + ([] if gone else [((5 if cut else 0), "K", role), (1 + (5 if cut else 0), "R", "u"), (1 + (5 if cut else 0), "R", "a")])
               for role, gone, cut in rows]
    inserts = [[], ["u"], ["a"], ["u", "a"], ["a", "u"]]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for picked in itertools.product(*choices):
            roles, audit, cost = "".join(gaps[0]), "I" * len(gaps[0]), 5 * sum(map(len, gaps))
            for (price, letter, role), gap in zip(picked, gaps[1:]):
                roles += (role or "") + "".join(gap)
                audit += letter + "I" * len(gap)
                cost += price
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_agenda_is_lightest(seed):
    draw = random.Random(seed)
    rows = [(draw.choice("suax"), draw.random() < 0.2, draw.random() < 0.3) for _ in range(draw.randrange(4))]
    ((cost, audit, _),) = convrepair.lightest(rows, {convrepair.NONE: (0, "")}, last=True).values()
    assert (cost, audit) == plain(rows)


@pytest.mark.parametrize("part", [1, 2, 7])
def test_parts_change_nothing(monkeypatch, part):
    draw = random.Random(part)
    rows = [(i, draw.choice(["system", "user", "user", "assistant"]), f"text {i}.", draw.choice([None, None, "truncated", "blank"])) for i in range(60)]

    def result():
        one = convrepair.Repair()
        for row in rows:
            one.add(*row)
        return one.result()

    whole = result()
    monkeypatch.setattr(convrepair, "PART_ROWS", part)
    assert result() == whole
    facts = [(r[1][0], r[3] == "blank", r[3] == "truncated") for r in rows]
    ((cost, audit, _),) = convrepair.lightest(facts, {convrepair.NONE: (0, "")}, last=True).values()
    assert (whole["cost"], whole["audit"]) == (cost, audit)
    assert len(whole["roles"]) == len(audit)


def test_messages_give_the_digest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = {}
    for m in sorted(convrepair.messages(rows).collect(), key=lambda m: (m.conv_id, m.place)):
        said.setdefault(m.conv_id, []).append(f"{m.role}:{m.text}")
    for row in convrepair.audits(rows).collect():
        assert hashlib.sha256("\n".join(said.get(row.conv_id, [])).encode()).hexdigest() == row.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", row.roles.replace("-", ""))


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "Hello.", 0), (None, None, None, None, 0), (7, None, "user", "", 1), (7, 2**62, "assistant", "Yes. ", 1),
        (7, -(2**62), "user", "x" * 100_000, 1), (9, 3, "user", "Same.", 2), (9, 3, "user", "Same.", 2), (9, 4, "robot", "a ", 2),
    ]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _place int")
    got = {r.conv_id: r for r in convrepair.audits(given).collect()}
    assert set(got) == {None, 7, 9}
    con = database("/root/testdata/sf0.001")
    con.execute("create table small(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into small values (?, ?, ?, ?)", [r[:4] for r in rows if r[0] != 7])
    want = {r[0]: r for r in con.execute(convrepair.SQL.replace("from conversations", "from small")).fetchall()}
    assert got[7].gaps == 2**63 - 1 and set(want) == {None, 9}
    for key, row in want.items():
        one = got[key]
        assert row == (key, one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost, one.audit, one.repaired_sha256)
    assert convrepair.audits(given.limit(0)).count() == 0
    text_keys = given.selectExpr("cast(conv_id as string) conv_id", "turn", "role", "text")
    assert {(r.conv_id, r.turn_count) for r in convrepair.audits(text_keys).selectExpr("conv_id", "1 turn_count").collect()} == {(None, 1), ("7", 1), ("9", 1)}
