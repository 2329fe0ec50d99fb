"""Line dedup by a deletion-neighbourhood join.

Lines are sequences of words, and the edit bound is one word put in, taken out or replaced. A line goes if an earlier one, in the
order of (document, line), is equal, or is within the bound and both have at least ``MIN_WORDS`` words.

The neighbourhood of a line is the line and all its variants with one word taken out; two lines within the bound have a variant in
common. Only lines that can have a neighbour emit theirs: two such lines also share their first or last half, so four half keys per
distinct line are counted first. Variants are hashed keys; a minimum per key, and per key and place, gives each line's earliest
neighbour without listing pairs. It is then verified by the edit distance of the two lines.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import shingles
from tickloom.llm.held import give_back, let_go
from tickloom.session import materialize, small_side

MIN_WORDS = 8
# Bytes of text a worker takes lines from or out of at a time.
PART = 4 << 20
# Bytes of texts or lines that are hashed together.
JOINED = 1 << 18
# Rows given out together.
ROWS = 1 << 16

_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_MASK = (1 << 64) - 1


def _sums(words: np.ndarray) -> np.ndarray:
    """Sums of the words' hashes, each times a power for its place; entry ``m`` is of the first ``m`` words."""
    powers = np.full(len(words), _STEP, np.uint64)
    if len(words):
        powers[0] = 1
    sums = np.zeros(len(words) + 1, np.uint64)
    np.add.accumulate(words * np.multiply.accumulate(powers), out=sums[1:])
    return sums


_BACKS = np.ones(1, np.uint64)


def _backs(n: int) -> np.ndarray:
    """Powers of the step's inverse, that bring a stretch of terms to the start."""
    global _BACKS
    if len(_BACKS) < n:
        powers = np.full(2 * n, _BACK, np.uint64)
        powers[0] = 1
        _BACKS = np.multiply.accumulate(powers)
    return _BACKS


def keys_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's lines with words: their numbers, hashes, numbers of words, and four half keys each.

    The keys are of the first and last half of the line as the shorter or equal one of a pair, and as the longer one.
    """
    words, starts = shingles.words(text, fold=False)
    edges = _edges(text, starts)
    number = np.flatnonzero(edges[1:] > edges[:-1])
    first, last = edges[number], edges[number + 1]
    sums, backs = _sums(words), _backs(len(words) + 1)

    def stretch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (sums[b] - sums[a]) * backs[a]

    n, halves = last - first, []
    for m in (n, n - 1):
        mark = m.astype(np.uint64) * np.uint64(4)
        halves += [stretch(first, first + m // 2) + mark, stretch(last - (m - m // 2), last) + mark + np.uint64(1)]
    keys = shingles._mixed(np.stack(halves, axis=1)).astype(np.int64)
    return number, shingles._mixed(stretch(first, last)).astype(np.int64), n, keys


def _edges(text: bytes, starts: np.ndarray) -> np.ndarray:
    """How many words begin before each line of a text, and before its end."""
    ends = np.searchsorted(starts, np.flatnonzero(np.frombuffer(text, np.uint8) == 10))
    return np.concatenate([[0], ends, [len(starts)]]).astype(np.int64)


def _joined(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of about ``JOINED`` bytes, or of one longer text."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > JOINED:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text) + 1
    if run:
        yield run


def keys_of_all(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`keys_of` of several texts, after the places of the lines' texts in the list."""
    before = np.cumsum([0] + [text.count(10) + 1 for text in texts])
    number, h, n, keys = keys_of(b"\n".join(texts))
    place = np.searchsorted(before, number, "right") - 1
    return place, number - before[place], h, n, keys


def lines_of(docs: DataFrame) -> DataFrame:
    """From ``doc, text``: ``doc, line, h, halves`` of every line with words; short ones have no ``halves``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in shingles.in_parts(batches, "text", PART):
            ids, at = batch.column("doc").to_numpy(), 0
            for run in _joined(shingles.texts(batch.column("text"))):
                place, number, h, n, keys = keys_of_all(run)
                docs = ids[at + place]
                at += len(run)
                long = n >= MIN_WORDS
                offsets = np.concatenate([[0], np.cumsum(long * 4)]).astype(np.int32)
                halves = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[long].ravel()))
                columns = [pa.array(docs), pa.array(number.astype(np.int32)), pa.array(h), halves]
                yield pa.record_batch(columns, ["doc", "line", "h", "halves"])
        give_back()

    return docs.mapInArrow(run, "doc long, line int, h long, halves array<long>")


def _cut(rows: DataFrame) -> DataFrame:
    """From ``text, wanted`` (lines with their hashes): ``h, doc, line, words`` (the line)."""
    fields = {"h": pa.int64(), "doc": pa.int64(), "line": pa.int32(), "words": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in shingles.in_parts(batches, "text", PART):
            wanted = batch.column("wanted")
            h, line = (wanted.flatten().field(name).to_numpy(zero_copy_only=False) for name in ("h", "line"))
            ends = np.cumsum(pc.list_value_length(wanted).fill_null(0).to_numpy(zero_copy_only=False))
            there, words, at = np.zeros(len(line), bool), [], 0
            for text, end in zip(shingles.texts(batch.column("text")), ends.tolist()):
                parts = text.split(b"\n")
                for i, number in enumerate(line[at:end].tolist(), at):
                    if number < len(parts):
                        there[i] = True
                        words.append(parts[number])
                at = end
            docs = np.repeat(batch.column("doc").to_numpy(), np.diff(ends, prepend=0))
            out = (h[there], docs[there], line[there], pa.array(words, pa.binary()).cast(pa.string()))
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(out, fields.values())], list(fields))
        give_back()

    return rows.mapInArrow(run, "h long, doc long, line int, words string")


def _neighbourhoods(lines: DataFrame) -> DataFrame:
    """``h, doc, line, key, place`` of each line: itself at place -1, and without each of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            at = 0
            for run in _joined(shingles.texts(batch.column("words"))):
                yield from _rows(batch.slice(at, len(run)), run)
                at += len(run)
        give_back()

    return lines.mapInArrow(run, "h long, doc long, line int, key long, place int")


def _rows(batch: pa.RecordBatch, lines: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`_neighbourhoods` of the lines of a batch; none of those that are not the line their hash is of."""
    text = b"\n".join(lines)
    words, starts = shingles.words(text, fold=False)
    edges = _edges(text, starts)
    first, last = edges[:-1], edges[1:]
    sums, backs = _sums(words), _backs(len(words) + 1)
    whole = shingles._mixed((sums[last] - sums[first]) * backs[first]).astype(np.int64)
    same = np.flatnonzero(whole == batch.column("h").to_numpy())  # else another row of a repeated id
    n = (last - first)[same]
    which = np.repeat(same, n + 1)
    places = np.arange(len(which)) - np.repeat(np.cumsum(n + 1) - n, n + 1)
    a, b = first[which], last[which]
    gap = a + np.maximum(places, 0)  # at place -1 no word is left out
    without = sums[gap] - sums[a] + (sums[b] - sums[np.minimum(gap + 1, b)]) * np.uint64(_BACK)
    keys = np.where(places < 0, whole[which], shingles._mixed(without * backs[a]).astype(np.int64))
    for at in range(0, len(which), ROWS):
        part = which[at : at + ROWS]
        taken = [batch.column(name).take(pa.array(part)) for name in ("h", "doc", "line")]
        columns = [*taken, pa.array(keys[at : at + ROWS]), pa.array(places[at : at + ROWS].astype(np.int32))]
        yield pa.record_batch(columns, ["h", "doc", "line", "key", "place"])


def within_one(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two lines are at most one word apart."""
    out = []
    for x, y in zip(a, b):
        x, y = sorted((_words(x.as_py()), _words(y.as_py())), key=len)
        same = 0
        while same < len(x) and x[same] == y[same]:
            same += 1
        out.append(len(y) - len(x) < 2 and x[same + (len(x) == len(y)) :] == y[same + 1 :])
    return pa.array(out, pa.bool_())


def _words(line: str) -> list[bytes]:
    return line.encode().split()  # splits bytes at just the six separators


def near_lines(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """``h`` of the lines that an earlier one is within the bound of. ``distinct`` has ``h, first, halves``, a row per line."""
    keys = distinct.select("h", "first", F.explode("halves").alias("half"))
    shared = keys.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    wanted = keys.join(shared, "half").select("h", "first").distinct()
    by_doc = wanted.groupBy(F.col("first.doc").alias("doc")).agg(
        F.collect_list(F.struct("h", F.col("first.line").alias("line"))).alias("wanted")
    )
    by_doc, _ = small_side(by_doc)
    lines = materialize(_cut(docs.join(by_doc, "doc").select("doc", "text", "wanted")))
    rows = _neighbourhoods(lines)
    position = F.struct("doc", "line", "h")
    per_key = rows.groupBy("key").agg(
        F.min(F.when(F.col("place") < 0, position)).alias("whole"), F.min(F.when(F.col("place") >= 0, position)).alias("cut"),
        F.count("*").alias("n"),
    ).filter("n > 1")
    per_place = rows.filter("place >= 0").groupBy("key", "place").agg(F.min(position).alias("same"), F.count("*").alias("n")).filter("n > 1")
    found = rows.join(per_key.drop("n"), "key").join(per_place.drop("n"), ["key", "place"], "left")
    earliest = F.least("whole", F.when(F.col("place") < 0, F.col("cut")).otherwise(F.col("same")))
    found = found.withColumn("other", earliest).filter(F.col("other") < position)
    found = found.groupBy("h").agg(F.min("other").alias("other")).select("h", F.col("other.h").alias("other"))
    texts = lines.groupBy("h").agg(F.min("words").alias("words"))
    pairs = found.join(texts, "h").join(texts.select(F.col("h").alias("other"), F.col("words").alias("before")), "other")
    return pairs.filter(F.arrow_udf("boolean")(within_one)("words", "before")).select("h")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` without its repeated lines, and ``n_lines, n_kept`` (lines with words, before and after).

    Blank lines stay. A null text stays null and has no lines. Rows with a null key keep all their lines and no line goes
    because of them; lines at the same place of rows that repeat a key do not count as repeated. Very long lines are taken whole.
    Columns named ``n_lines`` and ``n_kept`` are replaced, others come back as they are, an empty table as an empty one.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).filter("doc is not null")
    lines = materialize(lines_of(rows))
    distinct = lines.groupBy("h").agg(
        F.min(F.struct("doc", "line")).alias("first"), F.max("halves").alias("halves"), F.count("*").alias("n")
    )
    distinct = materialize(distinct)
    near = near_lines(distinct, rows).withColumn("near", F.lit(True))
    special = distinct.select("h", "first", "n").join(near, "h", "left").filter("n > 1 or near")
    special, _ = small_side(special.select("h", "first", "near"))
    gone = lines.join(special, "h").filter(F.col("near").isNotNull() | (F.struct("doc", "line") > F.col("first")))
    gone = gone.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("line").alias("_gone"))
    gone, _ = small_side(gone)
    joined = docs.join(gone, F.col(key).cast("long") == F.col("_doc"), "left")
    # Else a filter on the counts would take the lines out twice, in two workers of a task.
    keep = F.arrow_udf("text string, n_lines int, n_kept int")(_keep).asNondeterministic()
    kept = joined.withColumn("_kept", keep(F.col(text).cast("string"), F.col("_gone")))
    fields = {text: F.col("_kept.text"), "n_lines": F.col("_kept.n_lines"), "n_kept": F.col("_kept.n_kept")}
    return kept.withColumns(fields).drop("_doc", "_gone", "_kept")


def _keep(texts: pa.Array, gone: pa.Array) -> pa.Array:
    let_go()
    rows = pa.record_batch([texts, gone], ["text", "gone"])
    done = [_kept(part.column("text"), part.column("gone")) for part in shingles.in_parts([rows], "text", PART)]
    give_back()
    return pa.concat_arrays(done or [_kept(texts, gone)])


def _kept(texts: pa.Array, gone: pa.Array) -> pa.Array:
    out, counts, left = [], [], []
    for text, lines in zip(texts.cast(pa.large_binary()), gone):
        text, lines = text.as_py(), set(lines.as_py() or ())
        parts = text.split(b"\n") if text is not None else []
        filled = sum(1 for part in parts if part and not part.isspace())  # bytes are blank by just the six separators
        out.append(text if not lines else b"\n".join(p for i, p in enumerate(parts) if i not in lines))
        counts.append(filled)
        left.append(filled - len(lines))
    return pa.StructArray.from_arrays(
        [pa.array(out, pa.binary()).cast(pa.string()), pa.array(counts, pa.int32()), pa.array(left, pa.int32())],
        ["text", "n_lines", "n_kept"],
    )


SQL = r"""
with raw as (
  select doc_id, text, unnest(string_split(text, chr(10))) part, generate_subscripts(string_split(text, chr(10)), 1) line from documents
), lines as (
  select doc_id, line, regexp_extract_all(part, '[^\x20\x09-\x0D]+') w from raw where regexp_matches(part, '[^\x20\x09-\x0D]')
), firsts as (
  select w, min({'d': doc_id, 'l': line}) first from lines group by w
), long as (
  select w, first, row_number() over () id from firsts where len(w) >= 8
), variants as (
  select id, first, w v, 0 i from long
  union all
  select id, first, w[1:i - 1] || w[i + 1:] v, i from (select *, unnest(range(1, len(w) + 1)) i from long)
), near as (
  select distinct long.w from variants a join variants b on a.v = b.v and a.id <> b.id and (a.i = 0 or b.i = 0 or a.i = b.i)
    and b.first < a.first join long on long.id = a.id
), judged as (
  select doc_id, line, {'d': doc_id, 'l': line} > first or near.w is not null gone
  from lines join firsts using (w) left join near using (w)
), kept as (
  select raw.doc_id, string_agg(part, chr(10) order by raw.line) kept
  from raw left join judged on raw.doc_id = judged.doc_id and raw.line = judged.line where gone is distinct from true group by 1
), counts as (
  select doc_id, count(*) n_lines, count(*) filter (not gone) n_kept from judged group by 1
)
select doc_id, coalesce(n_lines, 0)::integer n_lines, coalesce(n_kept, 0)::integer n_kept,
  sha256(case when text is not null then coalesce(kept, '') end) kept_sha256
from documents left join counts using (doc_id) left join kept using (doc_id)
"""
