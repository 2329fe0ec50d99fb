"""Conversation structure repair by a lightest-derivation agenda.

A conversation's rows and their possible edits are items of a weighted hypergraph. A deduction takes what has been made of the first
i rows, in a state of the grammar, and an edit of the next row, and makes one row more of it; an insertion makes no row more. Items
wait on an agenda in the order of (cost, audit); both functions only let this order grow, and two audits of the same cost and the
same rows are never the beginning of one another, so an item that is popped is final, and the goal too.

Rows are read in order as a stream: a part of ``PART_ROWS`` rows at a time, with the (cost, audit, running digest) of the four states
carried to the next part. Memory is thus bounded however long a conversation is; the digest of a repaired conversation can only be
made in one pass from its start to its end, so that pass is one task's.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What words do not consist of, marks that end a sentence, and the costs of edits
BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
UNENDED = 5

# States of s?(ua)+ by what stands last; nothing at all is accepted too.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NONE: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {"u": "user", "a": "assistant"}
ACCEPTED = (NONE, ASSISTANT)

# Rows of one conversation, and letters of their texts, that are looked at together.
PART_ROWS = 512
PART_LETTERS = 1 << 22


def _edits(initial: str, must_go: bool, unended: bool) -> list[tuple[int, str]]:
    more = UNENDED if unended else 0
    return [(COST[DELETE], DELETE)] + ([] if must_go else [(COST[KEEP] + more, KEEP), (COST[REROLE] + more, REROLE)])


def _made(state: int, letter: str, initial: str) -> Iterator[int]:
    """States after an edit of a row (or an insertion) in ``state``."""
    if letter == DELETE:
        yield state
    elif letter == KEEP:
        if initial in NEXT[state]:
            yield NEXT[state][initial]
    else:  # a new role, of which the grammar leaves one
        for role in ROLES:
            if role in NEXT[state]:
                yield NEXT[state][role]


def lightest(rows: list[tuple[str, bool, bool]], starts: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str, int]]:
    """``end state -> (cost, audit, start state)`` of the lightest derivations over all ``rows``.

    ``rows`` are (role initial, has to go, ends without a mark); ``starts`` are the axioms, the states before the rows with their
    cost and audit. With ``last``, only the accepted end that is final first is given.
    """
    end = len(rows)
    agenda = [(cost, audit, 0, state, state) for state, (cost, audit) in starts.items()]
    heapq.heapify(agenda)
    final, ends = set(), {}
    while agenda:
        cost, audit, at, state, start = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == end:
            if not last:
                ends[state] = (cost, audit, start)
            elif state in ACCEPTED:
                return {state: (cost, audit, start)}
        for made in _made(state, INSERT, ""):
            if (at, made) not in final:
                heapq.heappush(agenda, (cost + COST[INSERT], audit + INSERT, at, made, start))
        if at < end:
            initial, must_go, unended = rows[at]
            for more, letter in _edits(initial, must_go, unended):
                for made in _made(state, letter, initial):
                    if (at + 1, made) not in final:
                        heapq.heappush(agenda, (cost + more, audit + letter, at + 1, made, start))
    return ends


@dataclass
class _Path:
    cost: int = 0
    audit: str = ""
    roles: str = ""
    digest: object = field(default_factory=hashlib.sha256)
    empty: bool = True

    def followed(self, state: int, cost: int, audit: str, rows: list) -> _Path:
        """This path continued by ``audit`` over ``rows`` of (role, text, ...)."""
        digest, empty, roles, left = self.digest.copy(), self.empty, [], iter(rows)
        for letter in audit:
            role, text = ("", "") if letter == INSERT else next(left)[:2]
            if letter == DELETE:
                roles.append("-")
                continue
            state = next(_made(state, letter, role[:1]))
            role = role if letter == KEEP else ROLES["u" if state == USER else "a"]
            digest.update((("" if empty else "\n") + f"{role}:{text}").encode())
            empty = False
            roles.append(role[:1])
        return _Path(cost, self.audit + audit, self.roles + "".join(roles), digest, empty)


class Repair:
    """Repairs one conversation whose rows come in order."""

    def __init__(self):
        self.done_audit, self.done_roles = [], []
        self.paths: dict[int, _Path] = {NONE: _Path()}
        self.rows, self.letters = [], 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns, self.least, self.most, self.before = 0, None, None, None

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = role[:1]
        if fault:
            self.counts[fault] += 1
        self.rows.append((role, text, fault))
        self.letters += len(text)
        if len(self.rows) >= PART_ROWS or self.letters >= PART_LETTERS:
            self._go_on(last=False)

    def _go_on(self, last: bool) -> None:
        facts = [(role[:1], fault in ("blank", "duplicate"), fault == "truncated") for role, _, fault in self.rows]
        starts = {state: (path.cost, path.audit) for state, path in self.paths.items()}
        ends = lightest(facts, starts, last)
        self.paths = {
            state: self.paths[start].followed(start, cost, audit[len(self.paths[start].audit):], self.rows)
            for state, (cost, audit, start) in ends.items()
        }
        self.rows, self.letters = [], 0
        same = len(commonprefix([path.audit for path in self.paths.values()]))
        same = min(same, len(commonprefix([path.roles for path in self.paths.values()])))
        some = next(iter(self.paths.values()))
        self.done_audit.append(some.audit[:same])
        self.done_roles.append(some.roles[:same])
        for path in self.paths.values():
            path.audit, path.roles = path.audit[same:], path.roles[same:]

    def result(self) -> dict:
        self._go_on(last=True)
        (path,) = self.paths.values()
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return {
            "gaps": min(gaps, (1 << 63) - 1), **self.counts, "cost": path.cost, "audit": "".join(self.done_audit) + path.audit,
            "roles": "".join(self.done_roles) + path.roles, "repaired_sha256": path.digest.hexdigest(),
        }


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles string, repaired_sha256 string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation; one row of ``SUMMARY`` for each."""
    # Conversations are told apart by `first`, set on the first row of each, so that keys of any type need no comparison.
    one, key, ready = None, None, []

    def flushed(conv_type: pa.DataType) -> pa.RecordBatch:
        keys = pa.concat_arrays([k for k, _ in ready])
        results = [r for _, r in ready]
        ready.clear()
        names = [part.split()[0] for part in SUMMARY.split(", ")]
        kinds = [pa.string() if part.endswith("string") else pa.int64() for part in SUMMARY.split(", ")]
        return pa.record_batch([keys] + [pa.array([r[n] for r in results], k) for n, k in zip(names, kinds)], ["_conv", *names])

    for batch in batches:
        conv = batch.column("_conv")
        columns = [batch.column(n).to_pylist() for n in ("_first", "_gone", "_turn", "_role", "_text", "_fault")]
        for i, (first, gone, turn, role, text, fault) in enumerate(zip(*columns)):
            if first:
                if one:
                    ready.append((key, one.result()))
                one, key = Repair(), conv.slice(i, 1)
                if len(ready) >= 1000:
                    yield flushed(conv.type)
            if not gone:
                one.add(turn, role, text, fault)
    if one:
        ready.append((key, one.result()))
        yield flushed(key.type)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``_conv, _turn, _role, _text, _gone``: the rows after damage by crc32 of ``conv:turn``, nulls taken as one space.

    Dropped rows stay as ``_gone``, without text, so that their conversation is known.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    kind = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    faced = rows.select(
        F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), said[2].alias("_role"), said[3].alias("_text"),
        kind.alias("_kind"),
    )
    blank = F.lit("")
    words = (
        F.when(F.col("_kind").isin(0, 1), blank).when(F.col("_kind") == 2, F.translate("_text", ENDINGS, "")).otherwise(F.col("_text"))
    )
    times = F.when(F.col("_kind") == 3, 2).otherwise(1)
    return faced.select(
        "_conv", "_turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("_role"), words.alias("_text"),
        (F.col("_kind") == 0).alias("_gone"), F.explode(F.array_repeat(F.lit(0), times)),
    ).drop("col")


def fault(text: Column, nth: Column) -> Column:
    """The first fault of a row: blank, duplicate of an earlier one, or ending without a mark; null without fault."""
    stripped = F.rtrim(text, F.lit(BLANKS))
    return (
        F.when(stripped == "", "blank").when(nth > 1, "duplicate")
        .when(~F.substring(stripped, -1, 1).isin(*ENDINGS), "truncated")
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Damaged rows with fault and place, in partitions by conversation and in order there; texts are shuffled once."""
    dealt = rows.repartition("_conv")
    same = W.partitionBy("_conv", "_gone", "_role", "_text").orderBy(F.asc_nulls_first("_turn"))
    marked = dealt.withColumn("_nth", F.row_number().over(same))
    marked = marked.withColumn("_fault", fault(F.col("_text"), F.col("_nth")))
    order = W.partitionBy("_conv").orderBy("_gone", F.asc_nulls_first("_turn"), "_role", "_text", "_nth")
    return marked.withColumn("_place", F.row_number().over(order))


def audits(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of ``rows``, damaged and repaired: ``conv`` and the columns of ``SUMMARY``.

    ``audit`` has a letter per edit in order, ties going to the least; ``roles`` the role initial each edit leaves, ``-`` for none.
    Null keys are a conversation of their own; a null turn comes first, a null role or text is one space. Rows of one turn are in
    order of role and text, and repeated rows are duplicates. A conversation whose rows are all dropped has zeros, an empty audit and
    the digest of an empty text. Gaps that exceed a long are its largest value. Other columns are not read; an empty table gives an
    empty one.
    """
    stream = ordered(damaged(rows, conv, turn, role, text)).select(
        "_conv", (F.col("_place") == 1).alias("_first"), "_gone", "_turn", "_role", "_text", "_fault"
    )
    kind = rows.schema[conv].dataType.simpleString()
    return stream.mapInArrow(_repaired, f"_conv {kind}, {SUMMARY}").withColumnRenamed("_conv", conv)


def messages(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations themselves: ``conv, place, role, text, edit`` per message, inserted ones included, deleted ones not."""
    edits = audits(rows, conv, turn, role, text).select(
        F.col(conv).alias("_of"), F.posexplode(F.split("audit", "")).alias("place", "edit"), "roles"
    ).filter("edit <> ''")
    upto = W.partitionBy("_of").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    edits = edits.withColumn("_at", F.when(F.col("edit") != INSERT, F.sum((F.col("edit") != INSERT).cast("long")).over(upto)))
    edits = edits.withColumn("_left", F.expr("substring(roles, place + 1, 1)")).drop("roles").filter(F.col("edit") != DELETE)
    known = ordered(damaged(rows, conv, turn, role, text)).filter("not _gone")
    joined = edits.join(known, F.col("_of").eqNullSafe(F.col("_conv")) & (F.col("_at") == F.col("_place")), "left")
    new = F.when(F.col("_left") == "u", ROLES["u"]).otherwise(ROLES["a"])
    return joined.select(
        F.col("_of").alias(conv), "place", F.when(F.col("edit") == KEEP, F.col("_role")).otherwise(new).alias("role"),
        F.coalesce("_text", F.lit("")).alias("text"), "edit",
    )


def _crc(text: str) -> str:
    """CRC-32 of a text in SQL, bit by bit by the usual rule."""
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::bigint)"
    bits = f"list_reduce(range(8), lambda c, k: {step}, xor(acc, b))"
    return f"xor(list_reduce({data}, lambda acc, b: {bits}, 4294967295::bigint), 4294967295::bigint)"


SQL = rf"""
with recursive kinds as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind
  from conversations
), rows_ as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text
  from kinds, lateral (select unnest(range(case when kind = 3 then 2 else 1 end))) where kind > 0
), marked as (
  select *, row_number() over (partition by conv_id, role, text order by turn nulls first) as nth,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as stripped
  from rows_
), faults as (
  select conv_id, turn, role, text, left(role, 1) as initial,
    case when stripped = '' then 'blank' when nth > 1 then 'duplicate' when right(stripped, 1) not in ('.', '!', '?') then 'truncated' end as fault,
    row_number() over (partition by conv_id order by turn nulls first, role, text, nth) as place
  from marked
), facts as (
  select *, lag(initial) over (partition by conv_id order by place) as before from faults
), sums as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
    (count(*) filter (fault = 'blank'))::bigint as blank, (count(*) filter (fault = 'duplicate'))::bigint as duplicate,
    (count(*) filter (fault = 'truncated'))::bigint as truncated,
    (count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')))::bigint as illegal, max(place) as n
  from facts group by conv_id
), inserts(a, ins, b) as (  -- n nothing, s, u, a: what stands last
  values ('n', '', 'n'), ('s', '', 's'), ('u', '', 'u'), ('a', '', 'a'), ('n', 'I', 'u'), ('s', 'I', 'u'), ('u', 'I', 'a'), ('a', 'I', 'u'),
    ('n', 'II', 'a'), ('s', 'II', 'a')
), steps(a, initial, edit, b) as (
  values ('n', 's', 'K', 's'), ('n', 'u', 'K', 'u'), ('s', 'u', 'K', 'u'), ('u', 'a', 'K', 'a'), ('a', 'u', 'K', 'u'),
    ('n', null, 'R', 'u'), ('s', null, 'R', 'u'), ('u', null, 'R', 'a'), ('a', null, 'R', 'u'),
    ('n', null, 'D', 'n'), ('s', null, 'D', 's'), ('u', null, 'D', 'u'), ('a', null, 'D', 'a')
), moves as (
  select conv_id, place, i.a, s.b, ins || edit as made,
    5 * length(ins) + case edit when 'D' then 2 when 'R' then 1 else 0 end + case when edit <> 'D' and fault = 'truncated' then 5 else 0 end as cost
  from facts, inserts i join steps s on i.b = s.a
  where coalesce(s.initial = facts.initial, true) and (edit = 'D' or fault is null or fault = 'truncated')
), paths as (
  select conv_id, 0::bigint as place, 'n' as state, {{'cost': 0, 'audit': ''}} as best from sums
  union all
  select p.conv_id, m.place, m.b, min({{'cost': best.cost + m.cost, 'audit': best.audit || m.made}})
  from paths p join moves m on p.conv_id is not distinct from m.conv_id and m.place = p.place + 1 and m.a = p.state
  group by p.conv_id, m.place, m.b
), goals as (
  select p.conv_id, min({{'cost': best.cost + 5 * length(ins), 'audit': best.audit || ins}}) as best
  from paths p join sums s on p.conv_id is not distinct from s.conv_id and p.place = s.n join inserts i on i.a = p.state
  where i.b in ('n', 'a') group by p.conv_id
), letters as (
  select conv_id, unnest(range(1, length(best.audit) + 1)) as k, best.audit as audit from goals
), edits as (
  select conv_id, k, audit[k] as edit, length(replace(audit[1:k], 'I', '')) as place, length(replace(audit[1:k], 'D', '')) as kept from letters
), firsts as (
  select e.conv_id, min(case when e.edit = 'K' and f.initial = 's' then 1 else 0 end) as system_first
  from edits e left join facts f on e.conv_id is not distinct from f.conv_id and e.place = f.place
  where e.edit <> 'D' and e.kept = 1 group by e.conv_id
), texts as (
  select e.conv_id, sha256(string_agg(
    case when e.edit = 'K' then f.role when (e.kept - system_first) % 2 = 1 then 'user' else 'assistant' end || ':'
      || case when e.edit = 'I' then '' else f.text end, chr(10) order by e.k)) as digest
  from edits e join firsts on e.conv_id is not distinct from firsts.conv_id
    left join facts f on e.conv_id is not distinct from f.conv_id and e.place = f.place
  where e.edit <> 'D' group by e.conv_id
)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost,
  coalesce(best.audit, '') as audit, coalesce(digest, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c
  left join sums on c.conv_id is not distinct from sums.conv_id left join goals on c.conv_id is not distinct from goals.conv_id
  left join texts on c.conv_id is not distinct from texts.conv_id
"""
