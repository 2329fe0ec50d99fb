"""Phrase collocation mining by HAT-trie counting.

Phrases are counted level by level. A task keeps counts in a shallow trie over word ids whose leaves are hash containers; a container
that grows too large bursts into one per next word, and when the trie is full its largest subtrees are given out whole as sorted
runs, which are merged per prefix partition. Only phrases whose shorter parts reached the least count are counted at all: what did
so is kept in a bitmap of fixed size, which may let others pass but never stops one that has to be counted, so counts are exact
however full it is. Nothing else is held beyond a bound, and scores are columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.session import materialize, small_side

# What ends a piece, the least count, the longest phrase, the rows of a report, and the name of no language
BREAKS = b".,;:!?\n\x0b\x0c\r"
LEAST = 100
LONGEST = 5
REPORT = 2000
NOBODY = "und"

# Bits of what was frequent so far, in buckets as Spark's bitmap functions make them.
FILTER_BITS = 1 << 27
BUCKET_BITS = 1 << 15
# Bytes of text looked at together, entries of a trie, entries of a container, words remembered by a task.
CHUNK = 4 << 20
ENTRIES = 800_000
BURST = 16_384
WORDS = 1_000_000
# Rows given out together, phrases in a row of them at most, shards of the phrases with one first word, and parts of all phrases.
BATCH = 20_000
PACKED = 4096
SHARDS = 4
PARTS = 4096

# Lower case, tabs as spaces, one mark for all that ends a piece; it stands apart then and is a word of its own.
_PLAIN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(BREAKS)
)
_BREAK, _NOTHING = -1, -2
_ODD1, _ODD2, _ALL = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1

RUNS = "part int, lang string, phrases string, counts array<long>"


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The 64-bit key of a phrase from that of all but its last word, and that of the last word."""
    x = left * np.uint64(_ODD1) + right
    x ^= x >> np.uint64(29)
    x *= np.uint64(_ODD2)
    return x ^ (x >> np.uint64(32))


def _seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode())


def _word_key(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, _seed(lang))


def _phrase_key(lang: str, words: list[bytes]) -> int:
    keys = np.array([_word_key(lang, w) for w in words], np.uint64)
    return int(reduce(_mixed, [keys[i : i + 1] for i in range(len(keys))])[0])


class Seen:
    """The bitmap of frequent phrases."""

    def __init__(self, buckets: dict[int, bytes]):
        self.bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for bucket, content in buckets.items():
            at = (bucket - 1) * BUCKET_BITS // 8
            self.bits[at : at + BUCKET_BITS // 8] = np.frombuffer(content, np.uint8)
        self.view = memoryview(self.bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & np.uint64(FILTER_BITS - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def has_one(self, key: int) -> bool:
        at = key & (FILTER_BITS - 1)
        return self.view[at >> 3] >> (at & 7) & 1 == 1


class HatTrie:
    """Counts of sequences of ids in hash containers under a trie over the first ids.

    A container is keyed by the second id of pairs, and by the bytes of all further ids (four each) of longer sequences; one of these
    bursts into a container per second id when it grows too large.
    """

    def __init__(self, length: int):
        self.length = length
        self.root: dict[int, dict] = {}
        self.burst: dict[int, dict[bytes, dict]] = {}
        self.entries = 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of sequences (rows of ``grams``) that are sorted and distinct."""
        numbers = counts.tolist()
        if self.length == 2:
            rests = grams[:, 1].tolist()
        else:
            content, step = np.ascontiguousarray(grams[:, 1:].astype(">u4")).tobytes(), 4 * (self.length - 1)
            rests = [content[at : at + step] for at in range(0, len(content), step)]
        borders = [0, *(np.flatnonzero(np.diff(grams[:, 0])) + 1).tolist(), len(grams)]
        for first, lo, hi in zip(grams[borders[:-1], 0].tolist(), borders, borders[1:]):
            if first in self.burst:
                below = self.burst[first]
                for rest, n in zip(rests[lo:hi], numbers[lo:hi]):
                    held = below.setdefault(rest[:4], {})
                    self.entries += rest not in held
                    held[rest] = held.get(rest, 0) + n
                continue
            held = self.root.setdefault(first, {})
            before, get = len(held), held.get
            for rest, n in zip(rests[lo:hi], numbers[lo:hi]):
                held[rest] = get(rest, 0) + n
            self.entries += len(held) - before
            if len(held) > BURST and self.length > 2:
                below = self.burst[first] = {}
                for rest, n in self.root.pop(first).items():
                    below.setdefault(rest[:4], {})[rest] = n

    def spill(self, keep: int, place: np.ndarray) -> Iterator[tuple[np.ndarray, list[int]]]:
        """Take whole subtrees out until ``keep`` entries are left, the largest ones, in order of ``place`` of their first ids; each is a
        sorted run of sequences."""
        size = {first: len(held) for first, held in self.root.items()}
        size |= {first: sum(map(len, below.values())) for first, below in self.burst.items()}
        chosen, left = [], self.entries
        for first in sorted(size, key=lambda first: (-size[first], first)):
            if left <= keep:
                break
            chosen.append(first)
            left -= size[first]
        for first in sorted(chosen, key=lambda first: (place[first], first)):
            subtree = [self.root.pop(first)] if first in self.root else [held for _, held in sorted(self.burst.pop(first).items())]
            rests = [rest for held in subtree for rest in sorted(held)]
            counts = [held[rest] for held in subtree for rest in sorted(held)]
            more = np.array(rests)[:, None] if self.length == 2 else np.frombuffer(b"".join(rests), ">u4").reshape(-1, self.length - 1)
            self.entries -= len(rests)
            yield np.concatenate([np.full((len(rests), 1), first), more], axis=1).astype(np.int64), counts


class Counter:
    """Counts phrases of some lengths in the texts of one language."""

    class Ids(dict):
        def __init__(self, lang: str, seen: Seen | None):
            super().__init__({b"": _NOTHING, b"\n": _BREAK})
            self.seed, self.seen, self.words, self.keys = _seed(lang), seen, [], []

        def __missing__(self, word: bytes) -> int:
            key = xxhash.xxh64_intdigest(word, self.seed)
            if self.seen is not None and not self.seen.has_one(key):
                self[word] = _BREAK  # no frequent phrase goes over this word
                return _BREAK
            self[word] = at = len(self.words)
            self.words.append(word)
            self.keys.append(key)
            return at

    def __init__(self, lang: str, lengths: tuple[int, ...], seen: Seen | None):
        self.lang, self.lengths, self.seen = lang, lengths, seen
        self.total, self.waiting, self.size = 0, [], 0
        self._forget()

    def _forget(self) -> None:
        self.ids, self.keys = self.Ids(self.lang, self.seen), np.empty(0, np.uint64)
        self.tries = {n: HatTrie(n) for n in self.lengths if n > 1}
        self.ones = np.zeros(0, np.int64)  # single words need no trie

    def add(self, text: bytes) -> Iterator[pa.RecordBatch]:
        self.waiting.append(text)
        self.size += len(text)
        if self.size >= CHUNK:
            yield from self._count()

    def _count(self) -> Iterator[pa.RecordBatch]:
        data = b"\n".join(self.waiting).translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
        self.waiting, self.size = [], 0
        ids = np.fromiter(map(self.ids.__getitem__, data), np.int64, len(data))
        del data
        ids = ids[ids != _NOTHING]
        if len(self.keys) < len(self.ids.keys):
            self.keys = np.concatenate([self.keys, np.array(self.ids.keys[len(self.keys):], np.uint64)])
        for length, starts in self._starts(ids):
            if length == 1:
                counts = np.bincount(ids[starts], minlength=len(self.keys))
                counts[: len(self.ones)] += self.ones
                self.ones = counts
                self.total += len(starts)
            elif len(starts):
                node = ids[starts]
                for j in range(1, length):
                    pair = (node.astype(np.uint64) << np.uint64(32)) | ids[starts + j].astype(np.uint64)
                    if j < length - 1:
                        _, node = np.unique(pair, return_inverse=True)
                _, first, counts = np.unique(pair, return_index=True, return_counts=True)
                grams = np.stack([ids[starts[first] + j] for j in range(length)], axis=1)
                self.tries[length].add(grams, counts)
        if len(self.ids) > WORDS:
            yield from self._runs(0)
            self._forget()
        elif sum(t.entries for t in self.tries.values()) > ENTRIES:
            yield from self._runs(ENTRIES // 2)

    def _starts(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each length, where phrases stand all of whose shorter parts may be frequent."""
        fits = ids >= 0
        if 1 in self.lengths:
            yield 1, np.flatnonzero(fits)
        if max(self.lengths) < 2 or not len(self.keys):
            return
        own = self.keys[np.where(fits, ids, 0)]
        fits, key = fits[:-1] & fits[1:], own
        for length in range(2, max(self.lengths) + 1):
            if length in self.lengths:
                yield length, np.flatnonzero(fits)
            if length < min(self.lengths) and self.seen is not None:  # counted before, so the bitmap knows
                key = _mixed(key[: len(fits)], own[length - 1 : length - 1 + len(fits)])
                fits = fits & self.seen.has(key)
            fits = fits[:-1] & fits[1:]

    def _runs(self, keep: int) -> Iterator[pa.RecordBatch]:
        words, keys = np.array(self.ids.words, object), np.array(self.ids.keys, np.uint64)
        if len(self.ones) and not keep:
            shards = keys & np.uint64(PARTS - 1)
            order = np.argsort(shards, kind="stable")
            for lo in range(0, len(order), BATCH):
                part = order[lo : lo + BATCH]
                yield self._batch(shards[part], words[part].tolist(), self.ones[part].tolist())
        place = keys & np.uint64(PARTS - SHARDS)
        for trie in self.tries.values():
            parts, phrases, counts = [], [], []
            for ids, numbers in trie.spill(keep, place):
                parts.append(place[ids[:, 0]] | (keys[ids[:, 1]] & np.uint64(SHARDS - 1)))
                phrases += [b" ".join(row) for row in words[ids].tolist()]
                counts += numbers
                if len(phrases) >= BATCH:
                    yield self._batch(np.concatenate(parts), phrases, counts)
                    parts, phrases, counts = [], [], []
            if phrases:
                yield self._batch(np.concatenate(parts), phrases, counts)

    def _batch(self, parts: np.ndarray, phrases: list[bytes | None], counts: list[int]) -> pa.RecordBatch:
        columns = [
            pa.array((parts & np.uint64(0x7FFFFFFF)).astype(np.int32)), pa.array([self.lang] * len(phrases)),
            pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()),
        ]
        return pa.record_batch(columns, ["part", "lang", "phrase", "f"])

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield from self._count()
        yield from self._runs(0)
        if 1 in self.lengths and self.total:
            yield self._batch(np.zeros(1, np.uint64), [None], [self.total])  # all words of the language


def _counted(lengths: tuple[int, ...], seen_of) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = seen_of.value if seen_of is not None else None
        seen = Seen(buckets) if buckets is not None else None
        counters: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                if lang not in counters:
                    if len(counters) >= 16:  # many languages in one task: the one met first makes room
                        yield from counters.pop(next(iter(counters))).finish()
                    counters[lang] = Counter(lang, lengths, seen)
                yield from counters[lang].add(text.as_buffer().to_pybytes() if text.is_valid else b"")
        for counter in counters.values():
            yield from counter.finish()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of one partition as one row, joined by line feeds, which no word has, and their counts; a language's total has no phrases."""
    for batch in batches:
        part = batch.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        part, at = part[order], np.arange(len(order))
        begin = np.maximum.accumulate(np.where(np.diff(part, prepend=part[:1] - 1) != 0, at, 0))
        starts = np.flatnonzero((at - begin) % PACKED == 0)
        offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
        phrases = pa.ListArray.from_arrays(offsets, batch.column("phrase").take(pa.array(order)))
        found = pa.ListArray.from_arrays(offsets, batch.column("f").take(pa.array(order)))
        columns = [pa.array(part[starts]), batch.column("lang").take(pa.array(order[starts])), pc.binary_join(phrases, "\n"), found]
        yield pa.record_batch(columns, ["part", "lang", "phrases", "counts"])


def counts(texts: DataFrame, lengths: tuple[int, ...], seen: dict[int, bytes] | None) -> DataFrame:
    """``lang, phrase, f`` of all phrases of ``lengths`` that the bitmap lets pass.

    Runs are merged by prefix: what begins with a word goes to ``SHARDS`` of the ``PARTS`` parts by its second word, so that a frequent
    word is no hot group and a subtree's phrases still lie together. Subtrees are given out in order of their parts, and the phrases of
    a part are shuffled as one row, which makes them small.
    """
    context = texts.sparkSession.sparkContext
    shared = context.broadcast(seen) if seen is not None else None
    counted = _counted(lengths, shared)
    runs = texts.mapInArrow(lambda batches: _packed(counted(batches)), RUNS).repartition("part")
    single = F.expr(r"inline(arrays_zip(coalesce(split(phrases, '\n'), array(cast(null as string))), counts))").alias("phrase", "f")
    runs = runs.select("part", "lang", single)
    return runs.groupBy("part", "lang", "phrase").agg(F.sum("f").alias("f")).drop("part")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        at = [(_phrase_key(lang, phrase.encode().split(b" ")) & (FILTER_BITS - 1)) + 1 for lang, phrase in rows]
        yield pa.record_batch([pa.array(at, pa.int64())], ["at"])


def bitmap(frequent: DataFrame) -> dict[int, bytes]:
    """The buckets of the bitmap with the phrases of ``frequent``; ``FILTER_BITS`` at most come to the driver, whatever their number."""
    places = frequent.select("lang", "phrase").mapInArrow(_places, "at long")
    rows = places.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    return {row.bucket: bytes(row.bits) for row in rows.collect()}


def _joined(old: dict[int, bytes], new: dict[int, bytes]) -> dict[int, bytes]:
    both = dict(old)
    for bucket, bits in new.items():
        if bucket in both:
            bits = np.bitwise_or(np.frombuffer(both[bucket], np.uint8), np.frombuffer(bits, np.uint8)).tobytes()
        both[bucket] = bits
    return both


def frequencies(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f, words`` of all phrases with at least ``least`` occurrences, single words included; and ``lang, n``.

    Three passes over the texts count words, pairs and triples; one more counts all that is longer.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NOBODY)).alias("lang"), F.col(text).cast("string").alias("text"))
    passes = [(n,) for n in range(1, min(longest, 3) + 1)] + ([tuple(range(4, longest + 1))] if longest > 3 else [])
    parts, seen, totals = [], None, None
    for lengths in passes:
        found = materialize(counts(texts, lengths, seen).filter(F.col("phrase").isNull() | (F.col("f") >= least)))
        if lengths == (1,):
            totals = found.filter("phrase is null").select("lang", F.col("f").alias("n"))
            found = found.filter("phrase is not null")
        parts.append(found)
        if lengths != passes[-1]:
            seen = _joined(seen or {}, bitmap(found))
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("words", F.regexp_count("phrase", F.lit(" ")) + 1), totals


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score`` of every frequent phrase of two words or more, by its lowest cut."""
    cuts = frequent.filter("words > 1").select(
        "lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k")
    )
    cuts = cuts.withColumns({
        "first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)"),
    })
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    rows = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(small_side(totals)[0], "lang")
    score = "(1000BD * cast(a as decimal(38, 0)) * cast(n as decimal(38, 0))) div (cast(l as decimal(38, 0)) * cast(r as decimal(38, 0)))"
    best = F.min(F.struct(F.expr(score).alias("score"), "k", "l", "r"))
    rows = rows.groupBy("lang", "phrase", "words", "a", "n").agg(best.alias("best"))
    return rows.select("lang", "phrase", "words", "a", "best.l", "best.r", "n", "best.score")


def mined(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, report: int = REPORT,
    absorbed: int = 100,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``report`` best phrases of each language.

    Phrases that stand inside a longer candidate with at least ``absorbed`` percent of their count are left out. A longer one never has
    more occurrences than its parts, so looking at phrases with one word more is enough. Null languages are ``und``, null texts are
    empty. Repeated rows count each time; very long texts are read whole. Other columns are not read; a table without frequent phrases
    gives an empty result.
    """
    frequent, totals = frequencies(docs, lang, text, least, longest)
    rows = scored(frequent, totals)
    parts = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    longer = frequent.filter("words > 2").select("lang", F.explode(parts).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    rows = rows.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"longer is null or 100 * longer < {absorbed} * a"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= report)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), split as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces
), grams as (
  select lang, words[i:i + k - 1] as gram
  from split, (select unnest(range(1, 6)) as k) ks, lateral (select unnest(range(1, len(words) - k + 2)) as i)
), counted as (
  select lang, array_to_string(gram, ' ') as phrase, len(any_value(gram)) as words, count(*) as f from grams group by lang, phrase
), totals as (
  select lang, sum(f)::bigint as n from counted where words = 1 group by lang
), frequent as (
  select * from counted where f >= 100
), cuts as (
  select c.lang, c.phrase, c.words, c.f as a, k, l.f as l, r.f as r, n,
    ((1000::hugeint * c.f * n) // (l.f::hugeint * r.f))::bigint as score
  from frequent c, lateral (select unnest(range(1, c.words)) as k), frequent l, frequent r, totals
  where c.words > 1 and l.lang = c.lang and r.lang = c.lang and totals.lang = c.lang
    and l.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ') and r.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')
), best as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), kept as (
  select * from best b where not exists (
    select 1 from frequent o
    where o.lang = b.lang and o.words > b.words and contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') and 100 * o.f >= 100 * b.a)
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select lang, rank::bigint as rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""
