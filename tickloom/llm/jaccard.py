"""Exact Jaccard join of word shingles, and the groups its links make.

Equal sets are one class from the start. Each set's tokens (hashed shingles) have one order for all: by hash, tokens that many
documents share last. Index keys are pairs of tokens that follow each other in that order: a token in one set only breaks one such
pair of the other set at most, so two similar sets have half of their pairs in common, and one among the first half of either, in one
order of the pairs. A passage that many documents share hardly ever gives them a pair, as their own tokens come in between. Small
sets, where a half is little, are indexed by single tokens, a quarter of them.

* **Short lists.** Entries lie in order of size; sizes too far apart are skipped as a block, and so are places too late in the order
  for enough keys to follow. What is left are candidates, a few for each entry at most, which are first bounded by small count sketches
  of the whole sets, then verified on the texts.
* **Longer lists.** Their sets are mostly copies of one text with edits. Pairs are not listed. Lists that lie together are a family. A
  reference set is made for it (tokens that most of a few members have), and each member is kept as its difference from it, which gives
  its overlap with every other member: what both differ by adds to it, the rest is known. Members close to the reference are linked
  through the closest one. The others are compared with all members, in blocks by their differences; a block gives out links, which
  are no more than its members where groups are all that is asked for.

For groups a link to the closest member is enough. Where all links are asked for, the members close to the reference are compared in
blocks as well. Candidates of one family are not verified, as the family has compared them.

All lists are exact: no list, group or candidate is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import shingles
from tickloom.llm.components import components
from tickloom.llm.held import give_back, let_go
from tickloom.session import materialize, small_side

# Similar: PART * overlap >= SHARE * union.
SHARE, PART = 75, 100
WIDTH = 5
# Lists up to this length are paired, which makes a few pairs an entry; longer ones go by differences from a reference set.
SHORT = 8
# Sets up to this size are indexed by tokens, sets from SHARE / PART of it on by pairs of tokens, so those in between by both.
SMALL = 32
# Members of a block of a family, about, if they have no more than TOKENS differences; tokens of more members go by matrices.
BLOCK, FEW = 256, 32
# Members a reference set is made of.
SAMPLE = 33
# A token is taken as common if it is in more documents than this, and than this part of them. At most so many are sent to tasks.
COMMON, COMMON_PART, COMMON_MOST = 32, 1 / 5000, 200_000
# Tokens a task counts or keeps at a time, and index entries per bucket, about.
TOKENS = 1 << 20
BUCKET = 1 << 20
# Pairs a task holds at a time, and bytes of text, about.
PAIRS, PART_BYTES = 1 << 20, 4 << 20

# A key of the index, the set, its least key, and its size and the key's place in single tokens, 0 in pairs.
ENTRY = np.dtype([("token", "u8"), ("id", "i8"), ("first", "u8"), ("size", "u4"), ("place", "u1")])
# Columns of packed entries.
INDEX = {"bucket": pa.int32(), "id": pa.int64(), "entries": pa.binary()}


def needed(a, b):
    """Overlap from which sets of these sizes are similar."""
    return -(-SHARE * (a + b) // (PART + SHARE))


def _first(n: int) -> int:
    """How many tokens, in the common order, are indexed of a small set of ``n``."""
    return n - -(-SHARE * n // PART) + 1 if n else 0


def _first_pairs(n: int) -> int:
    """How many pairs, in their order, are indexed of a set of ``n`` tokens, which has ``n - 1``.

    With ``o`` tokens in common and ``d`` in one set only, ``o - 1 - d`` pairs are in both. As ``o`` is at least
    ``SHARE / (PART + SHARE)`` of both sizes together, and the other size is at least ``SHARE / PART`` of this one, that is at least
    ``n * (2 * SHARE - PART) / PART - 1``.
    """
    return n - 1 - (n * (2 * SHARE - PART) // PART - 1) + 1


def index_keys(tokens: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a sorted set, which of them are common, and their places."""
    n, late = len(tokens), _among(tokens, common)
    ordered, late = np.concatenate([tokens[~late], tokens[late]]), np.concatenate([late[~late], late[late]])
    keys, commons, places = [], [], []
    if n <= SMALL:
        first = _first(n)
        keys.append(ordered[:first])
        commons.append(late[:first])
        places.append(np.arange(first))
    if PART * n >= SHARE * SMALL and n > 1:
        pairs = shingles._mixed(ordered[:-1] * np.uint64(3) + shingles._mixed(ordered[1:]))
        both = late[:-1] & late[1:]
        order = np.lexsort((pairs, both))[: _first_pairs(n)]
        keys.append(pairs[order])
        commons.append(both[order])
        places.append(np.zeros(len(order), np.int64))
    return np.concatenate(keys), np.concatenate(commons), np.concatenate(places)


def _arrow(fields: dict[str, pa.DataType], columns: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[name], kind) for name, kind in fields.items()], list(fields))


def sketch(tokens: np.ndarray) -> bytes:
    """Counts of tokens by some low bits of their hash; a power of two of counts, about half as many as tokens."""
    bits = max(3, len(tokens).bit_length() - 1)
    counts = np.bincount((tokens & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def most_shared(a: bytes, b: bytes) -> int:
    """A bound of the overlap of two sets from their sketches."""
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in (a, b))
    full = (x == 255).any() or (y == 255).any()
    size = min(len(x), len(y))
    x, y = x.reshape(-1, size).sum(axis=0), y.reshape(-1, size).sum(axis=0)
    return 1 << 62 if full else int(np.minimum(x, y).sum())


def sets_of(docs: DataFrame) -> DataFrame:
    """From ``doc_id, text``: ``doc_id, n, d1, d2, sketch`` per row, and rows without sketch: ``n`` documents have token ``d1``."""

    fields = {"doc_id": pa.int64(), "n": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "sketch": pa.binary()}

    def common(part: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(part), return_counts=True)
        often = counts > max(2, len(part) * COMMON_PART)
        tokens, counts = tokens[often].astype(np.int64), counts[often]
        none = [None] * len(tokens)
        return _arrow(fields, {"doc_id": none, "n": counts, "d1": tokens, "d2": none, "sketch": none})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        part, held = [], 0
        for batch in shingles.in_parts(batches, "text", PART_BYTES):
            rows = {name: [] for name in fields}
            rows["doc_id"] = batch.column("doc_id")
            for text in shingles.texts(batch.column("text")):
                tokens = shingles.shingle_set(text, WIDTH)
                d1, d2 = shingles.digest(tokens)
                for name, value in zip(("n", "d1", "d2", "sketch"), (len(tokens), d1, d2, sketch(tokens))):
                    rows[name].append(value)
                part.append(tokens)
                held += len(tokens)
                if held > TOKENS:
                    yield common(part)
                    part, held = [], 0
            yield _arrow(fields, rows)
        if part:
            yield common(part)
        give_back()

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch binary")


def _among(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which of the tokens are in the sorted ``common``."""
    if not len(common):
        return np.zeros(len(tokens), bool)
    return common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens


def _packed(parts: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Entries by bucket of their token, for packed rows; empties ``parts``."""
    entries = np.concatenate(parts)
    parts.clear()
    bucket = (entries["token"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield int(bucket[a]), entries[a:b].tobytes()


def _index_rows(parts: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of the index, some at a time; empties ``parts``."""
    def out(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return _arrow(INDEX, {"bucket": [b for b, _ in rows], "id": [None] * len(rows), "entries": [e for _, e in rows]})

    rows, size = [], 0
    for row in _packed(parts, buckets):
        rows.append(row)
        size += len(row[1])
        if size >= PART_BYTES:
            yield out(rows)
            rows, size = [], 0
    if rows:
        yield out(rows)


def index(docs: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """From ``doc_id, text``: packed index entries by ``bucket``; common keys stay out of it and come with their sets.

    Rows with a negative ``bucket``: the set ``id`` has the common keys ``entries`` among its first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        often, seen, parts, held = shared.value, set(), [], 0

        for batch in shingles.in_parts(batches, "text", PART_BYTES):
            late = []
            for text in shingles.texts(batch.column("text")):
                tokens = shingles.shingle_set(text, WIDTH)
                own = shingles.digest(tokens)[0]
                if own in seen or not len(tokens):
                    continue
                if len(seen) >= TOKENS:
                    seen.clear()
                seen.add(own)
                keys, is_common, places = index_keys(tokens, often)
                if is_common.any():
                    late.append((own, keys[is_common].tobytes()))
                entries = np.empty(len(keys), ENTRY)
                entries["token"], entries["id"], entries["size"], entries["place"] = keys, own, len(tokens), places
                entries = entries[~is_common]
                entries["first"] = entries["token"].min(initial=(1 << 64) - 1)
                parts.append(entries)
                held += len(keys)
                if held > TOKENS:
                    yield from _index_rows(parts, buckets)
                    held = 0
            away = [-1 - i % buckets for i, _ in late]
            yield _arrow(INDEX, {"bucket": away, "id": [i for i, _ in late], "entries": [e for _, e in late]})
        if parts:
            yield from _index_rows(parts, buckets)
        give_back()

    return docs.mapInArrow(run, "bucket int, id long, entries binary")


def _gathered(batches: Iterator[pa.RecordBatch], kind: np.dtype, *order: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's entries in order, and where the list of each token starts and ends."""
    entries = np.concatenate([np.frombuffer(e.as_buffer(), kind) for batch in batches for e in batch.column("entries")])
    entries = entries[np.lexsort([entries[name] for name in order])]
    same = (entries["token"][1:] == entries["token"][:-1]) & (entries["id"][1:] == entries["id"][:-1])
    if same.any():
        entries = entries[np.concatenate([[True], ~same])]
    cuts = np.flatnonzero(entries["token"][1:] != entries["token"][:-1]) + 1
    return entries, np.concatenate([[0], cuts]), np.concatenate([cuts, [len(entries)]])


def _places(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of all lists, the first before the second; lists of one size together, in parts of about PAIRS."""
    for size in np.unique(sizes[sizes > 1]).tolist():
        a, b = np.triu_indices(size, 1)
        own = starts[sizes == size]
        step = max(1, PAIRS // len(a))
        for at in range(0, len(own), step):
            first = own[at : at + step, None]
            yield (first + a).ravel(), (first + b).ravel()


def _distinct(kind: int, ids: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """``kind, a, b`` of pairs of places in the sorted ``ids``, given out when too many; repeated ones go, but for those given out before."""
    fields = {"kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), "entries": pa.binary()}
    waiting, size = [], 0

    def out(keys: np.ndarray) -> pa.RecordBatch:
        a, b = ids[(keys >> np.uint64(32)).astype(np.int64)], ids[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        return _arrow(fields, {"kind": np.full(len(a), kind), "a": a, "b": b, "entries": pa.nulls(len(a), pa.binary())})

    for a, b in parts:
        waiting.append((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
        size += len(a)
        if size > 2 * PAIRS:
            waiting = [np.unique(np.concatenate(waiting))]
            size = len(waiting[0])
            if size > PAIRS:
                yield out(waiting[0])
                waiting, size = [], 0
    if size:
        yield out(np.unique(np.concatenate(waiting)))


def _short(entries: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of places are not of sizes and places that rule a pair out."""
    size, place = entries["size"].astype(np.int64), entries["place"].astype(np.int64)
    left = np.minimum(size[a] - place[a], size[b] - place[b])
    return (SHARE * size[b] <= PART * size[a]) & (left >= needed(size[a], size[b]))


def scan(entries: DataFrame, short: int = SHORT) -> DataFrame:
    """``kind, a, b``: candidates (kind 0), and members ``b`` of the long list led by ``a`` (kind 1); kind 2 passes sets with common
    keys on: ``a`` and ``entries``.

    Sets with the same least key are together in its list, so other lists leave them out: most similar sets are found in one bucket.
    """
    fields = {"kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), "entries": pa.binary()}

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py() < 0:
            for batch in batches:
                n = batch.num_rows
                yield _arrow(fields, {"kind": [2] * n, "a": batch.column("id"), "b": [None] * n, "entries": batch.column("entries")})
            return
        let_go()
        every, starts, ends = _gathered(batches, ENTRY, "id", "size", "token")
        ids, rank = np.unique(every["id"], return_inverse=True)
        sizes, first = ends - starts, every["first"]
        long = sizes > short
        long &= (np.minimum.reduceat(first, starts) != np.maximum.reduceat(first, starts)) | (every["token"][starts] == first[starts])

        def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            listed = sizes <= short
            for a, b in _places(starts[listed], sizes[listed]):
                good = _short(every, a, b) & ((first[a] != first[b]) | (every["token"][a] == first[a]))
                x, y = rank[a[good]], rank[b[good]]
                yield np.minimum(x, y), np.maximum(x, y)

        def led() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for lo, hi in zip(starts[long].tolist(), ends[long].tolist()):
                leader = np.searchsorted(ids, _leader(every["id"][lo:hi]))
                yield np.full(hi - lo, leader), rank[lo:hi]

        yield from _distinct(0, ids, near())
        yield from _distinct(1, ids, led())
        del every, ids, rank, first
        give_back()

    return entries.groupBy("bucket").applyInArrow(run, "kind int, a long, b long, entries binary")


def _leader(ids: np.ndarray) -> int:
    return int(ids[np.argmin(shingles._mixed(ids.astype(np.uint64)))])


def common_members(late: DataFrame) -> DataFrame:
    """``kind, a, b`` of the lists of common tokens: each list's leader is a minimum, so no list is gathered."""
    kinds = "token long, h long, leader long"

    def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int]] = {}
        for batch in batches:
            for own, tokens in zip(batch.column("id").to_numpy(), batch.column("entries")):
                h = int(shingles._mixed(np.array([own], np.int64).astype(np.uint64)).astype(np.int64)[0])
                for t in np.frombuffer(tokens.as_buffer(), np.int64).tolist():
                    if t not in best or (h, own) < best[t]:
                        best[t] = (h, int(own))
        yield pa.record_batch(
            [pa.array(list(best), pa.int64()), pa.array([h for h, _ in best.values()], pa.int64()), pa.array([i for _, i in best.values()], pa.int64())],
            ["token", "h", "leader"],
        )

    least = late.mapInArrow(leaders, kinds).groupBy("token").agg(F.min_by("leader", F.struct("h", "leader")).alias("leader"))
    table = least.toArrow()  # one row per common token, which are few
    by_token = late.sparkSession.sparkContext.broadcast(dict(zip(table.column("token").to_pylist(), table.column("leader").to_pylist())))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for own, tokens in zip(batch.column("id").to_pylist(), batch.column("entries")):
                for leader in {by_token.value[t] for t in np.frombuffer(tokens.as_buffer(), np.int64).tolist()}:
                    a += [leader, leader] if leader != own else [leader]
                    b += [own, leader] if leader != own else [own]
            yield _arrow({"kind": pa.int32(), "a": pa.int64(), "b": pa.int64()}, {"kind": [1] * len(a), "a": a, "b": b})

    return late.mapInArrow(members, "kind int, a long, b long")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of candidates ``a, b`` (first digests), the links ``a, b`` between documents."""
    side = classes.select("d1", "n", "rep", "sketch")
    near = pairs.join(side.select(*[F.col(c).alias(f"a_{c}") for c in side.columns]), F.col("a") == F.col("a_d1"))
    near = near.join(side.select(*[F.col(c).alias(f"b_{c}") for c in side.columns]), F.col("b") == F.col("b_d1"))

    @F.arrow_udf("boolean")
    def may(na: pa.Array, nb: pa.Array, sa: pa.Array, sb: pa.Array) -> pa.Array:
        need = needed(na.to_numpy(), nb.to_numpy())
        return pa.array([most_shared(x.as_py(), y.as_py()) >= k for x, y, k in zip(sa, sb, need)], pa.bool_())

    near = near.filter(SHARE * F.greatest("a_n", "b_n") <= PART * F.least("a_n", "b_n")).filter(may("a_n", "b_n", "a_sketch", "b_sketch"))
    near = materialize(near.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"), F.col("a_d1").alias("ad"), F.col("b_d1").alias("bd")))
    ids = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = with_texts(ids, docs)
    rows = near.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    rows = rows.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")

    @F.arrow_udf("boolean")
    def similar(ad: pa.Array, bd: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y, i, j in zip(shingles.texts(a), shingles.texts(b), ad, bd):
            x, y = shingles.shingle_set(x, WIDTH), shingles.shingle_set(y, WIDTH)
            good = shingles.digest(x)[0] == i.as_py() and shingles.digest(y)[0] == j.as_py()
            both = len(np.intersect1d(x, y, assume_unique=True)) if good else 0
            out.append(good and PART * both >= SHARE * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return rows.filter(similar("ad", "bd", "a_text", "b_text")).select("a", "b")


def with_texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of the given documents."""
    side, _ = small_side(ids)
    return docs.join(side, "doc_id", "left_semi")


def drawn_of(place: Column, n: Column) -> Column:
    """Whether a member at ``place`` below 2**40 is among about SAMPLE of ``n``; a division, as the product may leave a long."""
    return place < F.floor(F.lit(SAMPLE << 40) / n)


class Families:
    """Long lists: members as differences from a reference set. ``members`` has ``family, id`` (first digests)."""

    def __init__(self, members: DataFrame, classes: DataFrame, docs: DataFrame):
        self.members, self.classes, self.docs = members, classes, docs

    def differences(self) -> DataFrame:
        """``family, id, rep, whole`` (size of the reference), ``minus, plus`` (tokens missing and added)."""
        known = self.classes.select(F.col("d1").alias("id"), "rep")
        members = materialize(self.members.join(known, "id"))
        rows = self.docs.join(small_side(members)[0], F.col("doc_id") == F.col("rep"))
        place = F.pmod(F.xxhash64("family", "id"), F.lit(1 << 40))
        # About SAMPLE members of each family make its reference; which ones changes costs, not results.
        sizes = members.groupBy("family").agg(F.count("*").alias("_n"))
        drawn = members.join(sizes, "family").filter(drawn_of(place, F.col("_n"))).select("family", "rep", "id")
        drawn = self.docs.join(small_side(drawn)[0], F.col("doc_id") == F.col("rep"))

        def refer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets = []
            for batch in batches:
                sets += [shingles.shingle_set(text, WIDTH) for text in shingles.texts(batch.column("text"))]
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.record_batch(
                [pa.array([key[0].as_py()], pa.int64()), pa.array([tokens[2 * counts > len(sets)].tobytes()], pa.binary())],
                ["family", "whole"],
            )

        references = drawn.select("family", "text").groupBy("family").applyInArrow(refer, "family long, whole binary")
        references, _ = small_side(references)
        # A family none of whose members was drawn has an empty reference, which is as right as any.
        rows = rows.join(references, "family", "left")
        fields = {
            "family": pa.int64(), "id": pa.int64(), "rep": pa.int64(), "whole": pa.int64(), "minus": pa.binary(), "plus": pa.binary(),
        }

        def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            let_go()
            for batch in shingles.in_parts(shingles.in_parts(batches, "text", PART_BYTES), "whole", PART_BYTES):
                out = {name: [] for name in fields}
                for i, (text, whole) in enumerate(zip(shingles.texts(batch.column("text")), batch.column("whole"))):
                    tokens, own = shingles.shingle_set(text, WIDTH), batch.column("id")[i].as_py()
                    if shingles.digest(tokens)[0] != own:
                        continue  # another row of a repeated id
                    ref = np.frombuffer(whole.as_py() or b"", np.uint64)
                    values = (
                        batch.column("family")[i].as_py(), own, batch.column("rep")[i].as_py(), len(ref),
                        np.setdiff1d(ref, tokens, assume_unique=True).tobytes(), np.setdiff1d(tokens, ref, assume_unique=True).tobytes(),
                    )
                    for name, value in zip(fields, values):
                        out[name].append(value)
                yield _arrow(fields, out)
            give_back()

        return rows.select("family", "id", "rep", "text", "whole").mapInArrow(
            differ, "family long, id long, rep long, whole long, minus binary, plus binary"
        )

    def solve(self, every: bool = False) -> DataFrame:
        """Links ``a, b``, enough of them that what is similar within a family is connected; with ``every`` all links within families.

        With ``cost = PART * |minus| + SHARE * |plus|`` and ``reach = (PART - SHARE) * whole``, two members are similar when
        ``PART + SHARE`` times what their differences share is at least the sum of their costs less the reach.
        """
        rows = materialize(self.differences())
        minus, plus = F.octet_length("minus") / 8, F.octet_length("plus") / 8
        rows = rows.withColumn("cost", ((PART * minus) + SHARE * plus).cast("long")).withColumn("reach", F.col("whole") * (PART - SHARE))
        closest = rows.groupBy("family").agg(F.min("cost").alias("least"), F.min_by("rep", F.struct("cost", "id")).alias("hub"))
        rows = rows.join(small_side(closest)[0], "family").withColumn("inner", F.expr("cost + least <= reach"))
        if every:
            return _block_links(rows.withColumn("inner", F.lit(False)), every)
        close = rows.filter("inner and rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
        return close.unionAll(_block_links(rows, every))


def _block_links(rows: DataFrame, every: bool) -> DataFrame:
    """``a, b``: links between members of families that are not both ``inner``, by blocks of members; each pair of blocks is a task's group.

    Without ``every``, a pair of blocks gives no more links than connect what is connected in it.
    """
    tokens = (F.octet_length("minus") + F.octet_length("plus")) / 8

    def blocks(part: Column) -> Column:
        return F.ceil(F.greatest(F.count_if(part) / BLOCK, F.coalesce(F.sum(F.when(part, tokens)), F.lit(0.0)) / TOKENS)).cast("int")

    sizes = rows.groupBy("family").agg(
        blocks(F.lit(True)).alias("all"), blocks(~F.col("inner")).alias("outs"), blocks(F.col("inner")).alias("ins"),
    )
    one = F.col("all") <= 1
    sizes = sizes.filter("outs > 0").select("family", F.when(one, 0).otherwise(F.col("ins")).alias("ins"), "outs")
    rows = rows.join(small_side(sizes)[0], "family")
    apart, place = F.col("inner") & (F.col("ins") > 0), F.xxhash64("id")
    own = F.when(apart, F.col("outs") + F.pmod(place, F.greatest("ins", F.lit(1)))).otherwise(F.pmod(place, F.col("outs"))).cast("int")
    last = F.col("outs") - 1 + F.when(apart, 0).otherwise(F.col("ins"))
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "cost", "reach", "minus", "plus")

    def check(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        reps, costs, blocks, sets, reach = [], [], [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                reps.append(row["rep"])
                costs.append(row["cost"])
                blocks.append(row["block"])
                sets.append(np.frombuffer(row["minus"] + row["plus"], np.uint64))
                reach = row["reach"]
        shared = _overlaps(sets)
        reps, costs, blocks = np.array(reps, np.int64), np.array(costs, np.int64), np.array(blocks)
        good = (PART + SHARE) * shared >= costs[:, None] + costs - reach
        good &= (blocks[:, None] != blocks) | (key[1].as_py() == key[2].as_py())
        a, b = np.nonzero(np.triu(good, 1)) if every else _forest(good)
        del sets, shared, good
        yield _arrow({"a": pa.int64(), "b": pa.int64()}, {"a": reps[a], "b": reps[b]})
        give_back()

    return rows.groupBy("family", "lo", "hi").applyInArrow(check, "a long, b long")


def _forest(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a symmetric matrix of links, some that connect what all connect, fewer than it has rows."""
    above, new = np.full(len(good), -1), np.ones(len(good), bool)
    for start in range(len(good)):
        if not new[start]:
            continue
        new[start], waiting = False, [start]
        while waiting:
            at = waiting.pop()
            found = np.flatnonzero(good[at] & new)
            above[found], new[found] = at, False
            waiting += found.tolist()
    below = np.flatnonzero(above >= 0)
    return above[below], below


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of the sets share. Pairs are counted for tokens of FEW sets; others go by matrices of some thousand tokens."""
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner, n = tokens[order], owner[order], len(sets)
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])[: len(tokens)])
    sizes = np.diff(np.append(starts, len(tokens)))
    shared, few, width = np.zeros(n * n, np.int64), sizes <= FEW, 4096
    for a, b in _places(starts[few], sizes[few]):
        shared += np.bincount(owner[a] * n + owner[b], minlength=n * n)
    shared = shared.reshape(n, n)
    shared += shared.T
    starts, sizes = starts[~few], sizes[~few]
    for at in range(0, len(starts), width):
        part = sizes[at : at + width]
        listed = np.concatenate([owner[a : a + m] for a, m in zip(starts[at : at + width].tolist(), part.tolist())])
        has = np.zeros((n, len(part)), np.float32)
        has[listed, np.repeat(np.arange(len(part)), part)] = 1
        shared += (has @ has.T).astype(np.int64)
    return shared


def links_of(docs: DataFrame, sets: DataFrame, classes: DataFrame, short: int = SHORT, every: bool = False) -> DataFrame:
    """``a, b``: links between the first documents of classes, enough of them that groups are whole; with ``every`` all links."""
    own = sets.filter("sketch is not null and n > 0")
    total = own.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    often = sets.filter("sketch is null").groupBy("d1").agg(F.sum("n").alias("n"))
    often = often.filter(F.col("n") > max(COMMON, total.rows * COMMON_PART)).orderBy(F.desc("n"), "d1").limit(COMMON_MOST)
    common = np.sort(often.toArrow().column("d1").to_numpy().astype(np.uint64))
    scanned = materialize(scan(index(docs, common, total.tokens // 2 // BUCKET + 8), short))
    late = common_members(scanned.filter("kind = 2").select(F.col("a").alias("id"), "entries"))
    pairs = scanned.filter("kind = 0").select("a", "b")
    inside = scanned.filter("kind = 1").select("kind", "a", "b").unionAll(late).select(F.col("a").alias("family"), F.col("b").alias("id"))
    families = materialize(_merged(inside.distinct()).distinct())
    links = Families(families, classes, docs).solve(every)
    return links.unionAll(verified(_outside(pairs.distinct(), families), classes, docs))


def _outside(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that no family has both of."""
    rows = pairs.join(members.select(F.col("id").alias("a"), F.col("family").alias("of")), "a")
    both = rows.join(members.select(F.col("id").alias("b"), F.col("family").alias("of")), ["b", "of"]).select("a", "b").distinct()
    return pairs.join(both, ["a", "b"], "left_anti")


def _merged(members: DataFrame) -> DataFrame:
    """Families whose leaders are members of another one go into it: what two sets are in together, they stay in together."""
    order = F.struct(F.xxhash64("family"), "family")
    least = members.groupBy("id").agg(F.min_by("family", order).alias("into"))
    for _ in range(2):
        into = least.withColumnRenamed("id", "family")
        joined = members.join(into, "family", "left")
        members = joined.select(F.coalesce("into", "family").alias("family"), "id").distinct()
    return members


def _prepared(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with a key, what is known of the sets, the part of it that has a row per document, and the classes of equal sets."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = materialize(sets_of(rows))
    named = rows.filter("doc_id is not null")
    own = sets.filter("sketch is not null")
    classes = own.filter("n > 0 and doc_id is not null").groupBy("d1", "d2", "n")
    classes = materialize(classes.agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))
    return named, sets, own, classes


def pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", short: int = SHORT) -> DataFrame:
    """``a, b``, a below b: every two different sets that are similar, each by the smallest key that has it.

    Sets and links are those of :func:`groups`. There are as many rows as links, which in a group of near copies grow with its square.
    """
    named, sets, _, classes = _prepared(docs, key, text)
    return _ordered(links_of(named, sets, classes, short, every=True))


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", short: int = SHORT) -> DataFrame:
    """``key, n_shingles, n_links`` of every row: to how many other sets its set is similar.

    It is 0 for sets without shingles and null for rows with a null key, which are not linked.
    """
    named, sets, own, classes = _prepared(docs, key, text)
    links = _ordered(links_of(named, sets, classes, short, every=True))
    counts = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    counts = classes.join(counts, "rep", "left").select("d1", "d2", "n", "links")
    out = own.select("doc_id", "n", "d1", "d2").join(counts, ["d1", "d2", "n"], "left")
    links = F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).cast("long")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), links.alias("n_links"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", short: int = SHORT) -> DataFrame:
    """``key, n_shingles, component_id`` of every row.

    Rows are linked when the sets of their texts are similar; equal sets are. A set is that of the distinct 5-word shingles of the
    lower-cased text (A-Z), or the whole sequence of fewer words. A null or empty text, or one without words, has no shingles and
    is alone. ``component_id`` is the smallest key reachable. Rows with a null key are not linked and have a null component.
    Rows of a repeated key are one node of the links, if their texts differ; repeated rows are kept. Very long texts are read
    whole; an empty table gives an empty one; other columns are not read.
    """
    named, sets, own, classes = _prepared(docs, key, text)
    reached = components(links_of(named, sets, classes, short))
    reached = classes.join(reached, F.col("rep") == F.col("node"), "left")
    reached = reached.select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    out = own.select("doc_id", "n", "d1", "d2").join(reached, ["d1", "d2", "n"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
