"""Document fingerprints from spot signatures.

A signature is a common word (the anchor) and the two content words that follow it; common words in between are passed over. A
document's fingerprint is its set of signatures, hashed and sorted; likeness is Jaccard's, which sets of too different lengths need
not be compared for. All of it is columns; nothing runs in Python.

``near_pairs`` finds all pairs of a table. Sets are partitioned by length, so that partners stand in the same partition or the next
one; within a partition they meet at the rarest signatures of either, and a pair is given up when the lengths, or what is left of
both after the signature they met at, cannot reach the likeness. Nothing is cut off: all pairs that reach it are given.

The neighbour of a document comes from chunks of the id axis, whose widths are made small enough for the densest stretch; a chunk's
last document gets the first one of the next chunk through a small table.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators import prefix
from tickloom.session import materialize, small_side

# Common words of English, German, French and Spanish
ANCHORS = (
    "a and are as by for in is of on that the this to was with das den der des die ein ist mit und von zu au dans de en est et la le les "
    "que un une con el es los para por se una"
).split()
# Content words of a chain, and most anchors passed over before each.
CHAIN, PASSED = 2, 8
# Likeness of near copies, where the caller names no other.
NEAR = 0.5
# Documents of a chunk, about, and the most that are let stand before chunks are made narrower.
CHUNK, DENSEST = 256, 2048

_ANY = "(?:" + "|".join(ANCHORS) + ")"
# At an anchor, without taking characters: the anchor, and CHAIN times some anchors and a content word.
_SPOT = f"(?<= )(?=({_ANY} (?:(?:{_ANY} ){{0,{PASSED}}}+(?!{_ANY} )[^ ]+ ){{{CHAIN}}}))"


def normal(text: Column) -> Column:
    """Letters and digits with A-Z lower-cased, a blank around each word."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def signatures(text: Column) -> Column:
    """Sorted distinct hashes; of a text without any, one of all its words."""
    words = normal(text)
    spots = F.regexp_extract_all(words, F.lit(_SPOT), F.lit(1))
    chains = F.transform(spots, lambda s: F.substring(F.md5(F.regexp_replace(s, f"(?<= ){_ANY} ", "").cast("binary")), 1, 12))
    alone = F.array(F.concat(F.lit("w"), F.substring(F.md5(words.cast("binary")), 1, 11)))
    return F.array_sort(F.array_distinct(F.when(F.size(chains) > 0, chains).otherwise(alone)))


def whole_signatures(text: Column) -> Column:
    """The same sets as sorted 64-bit hashes, with any number of anchors passed over."""
    words = normal(text)
    content = F.filter(F.split(F.trim(words), " "), lambda w: ~w.isin(*ANCHORS, ""))
    # The anchors before each content word, and after the last one.
    runs = F.split(F.regexp_replace(words, f"(?<= )(?!{_ANY} )[^ ]+ ", "|"), "[|]")
    last = F.greatest(F.size(content) - 1, F.lit(0))
    ends = F.zip_with(F.slice(content, F.lit(1), last), F.slice(content, F.lit(2), last), lambda a, b: F.concat(a, F.lit(" "), b, F.lit(" ")))
    chains = F.zip_with(F.slice(runs, F.lit(1), last), ends, lambda run, end: F.transform(
        F.filter(F.split(run, " "), lambda w: w != ""), lambda w: F.xxhash64(F.concat(w, F.lit(" "), end))
    ))
    chains = F.array_distinct(F.flatten(chains))
    return F.array_sort(F.when(F.size(chains) > 0, chains).otherwise(F.array(F.xxhash64(words))))


def fingerprint(text: Column) -> Column:
    return F.concat_ws(",", signatures(text))


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard's likeness of two fingerprints, 0 to 1; null without a look if their lengths rule out ``at_least``."""
    x, y = F.split(a, ","), F.split(b, ",")
    return _compared(x, y, F.size(x), F.size(y), at_least)


def _compared(x: Column, y: Column, n: Column, m: Column, at_least: float) -> Column:
    """Likeness of sets of ``n`` and ``m``, of which ``x`` and ``y`` are all that others can share."""
    both = F.size(F.array_intersect(x, y))
    return F.when(F.least(n, m) >= at_least * F.greatest(n, m), both / (n + m - both))


def _with_next(rows: DataFrame) -> DataFrame:
    """Add ``print``, and ``next_text, next_print`` of the next row in order of ``doc_id, text``, of the first one for the last.

    Only texts are shuffled, once; fingerprints are made where their chunk is.
    """
    made = fingerprint(F.col("text")).alias("print")
    span = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).first()
    if not span.n:
        return rows.select("*", made).select("*", F.col("text").alias("next_text"), F.col("print").alias("next_print"))
    width = min(1 << 62, max(1, (span.b - span.a + 1) * CHUNK // span.n))
    while width > 1:
        chunk = prefix.chunk_of(F.col("doc_id"), width)
        if rows.groupBy(chunk.alias("c")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= DENSEST:
            break
        width = max(1, width // 16)
    columns = rows.columns
    rows = rows.withColumn("_chunk", prefix.chunk_of(F.col("doc_id"), width))
    heads = materialize(rows.groupBy("_chunk").agg(F.min("doc_id").alias("_head")))
    heads = prefix.following(heads, [], "_chunk", {"_next": "_head"}).withColumn("_next", F.coalesce("_next", F.lit(span.a)))
    side, _ = small_side(heads.select(F.col("_chunk").alias("_to"), "_next"))
    edges = rows.join(side, F.col("doc_id") == F.col("_next")).groupBy("_to").agg(F.min("text").alias("text"))
    edges = edges.select("_to", F.struct("text", made).alias("_edge"))
    order = W.partitionBy("_chunk").orderBy("doc_id", "text")
    inside = rows.repartition("_chunk").select("*", made)
    inside = inside.select("*", F.lead(F.struct("text", "print")).over(order).alias("_following"))
    joined = inside.join(edges, F.col("_chunk") == F.col("_to"), "left")
    found = F.coalesce("_following", "_edge")
    return joined.select(*columns, "print", found["text"].alias("next_text"), found["print"].alias("next_print"))


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text is the text with its last quarter of code points replaced by as many first ones of the next row's text, in
    order of key and text; the last row is followed by the first. A null text is empty. Rows with a null key stand
    where the key -2**62 would, before all usual ones. Repeated rows follow each other. Very long texts are taken whole; an empty table gives an
    empty one; other columns are not read.
    """
    smallest = -(1 << 62)
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(smallest)).alias("doc_id"), F.col(key).isNull().alias("_none"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    rows = _with_next(rows)
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - part), F.substr("next_text", F.lit(1), part))
    rows = rows.select("*", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_print", fingerprint(F.col("edited")))
    return rows.select(
        F.when(~F.col("_none"), F.col("doc_id")).alias(key), "n_chars", "edited", F.col("print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def _partitions(at_least: Fraction) -> list[int]:
    """Smallest lengths of the partitions: the longest partner of a set is in its partition or the next one.

    Partitions are a quarter wide at least, so there are few of them close to 1 too.
    """
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(max(edges[-1] * at_least.denominator // at_least.numerator, edges[-1] * 5 // 4) + 1)
    return edges


def near_pairs(docs: DataFrame, at_least: float = NEAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``a, b, near``: all pairs of documents whose likeness is ``at_least`` (above 0, to 1) or more.

    Documents with equal fingerprints are given once each, as ``b``, with ``near`` 1 and the smallest key among them as ``a``; of
    others the pairs between those smallest keys are given, the smaller one as ``a``. Rows with a null key have no name
    and take no part; rows of a repeated key with different texts are compared, also with each other. A null text is empty.
    """
    share = Fraction(str(at_least))
    if not 0 < share <= 1:
        raise ValueError("at_least has to be above 0, and 1 at most")
    p, q = share.numerator, share.denominator

    def up(over: str, by: int) -> Column:
        return F.expr(f"({over} + {by - 1}) div {by}").cast("int")

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.filter("key is not null").select("key", whole_signatures(F.col("text")).alias("sigs"))
    rows = materialize(rows.select("key", F.xxhash64("sigs").alias("id"), F.size("sigs").alias("n"), "sigs"))
    first, _ = small_side(rows.groupBy("id").agg(F.min("key").alias("rep")))
    equal = rows.select("id", "key").join(first, "id").filter("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b")).distinct()
    one = rows.join(first, "id").filter("key = rep").select("id", "rep", "n", F.explode("sigs").alias("sig"))
    # A signature of one set only counts for lengths alone; it stands before the shared ones in the order of rareness.
    shared, _ = small_side(one.groupBy("sig").agg(F.count("*").alias("df")).filter("df > 1"))
    sets = one.join(shared, "sig").groupBy("id", "rep", "n").agg(F.array_sort(F.collect_set(F.struct("df", "sig"))).alias("sigs"))
    sets = sets.filter(F.size("sigs") >= up(f"bigint(n) * {p}", q))
    sets = materialize(sets.select("id", "rep", "n", F.transform("sigs", lambda s: s["sig"]).alias("sigs")))
    # So many of the rarest signatures can be missing, and one more is shared by partners.
    alone = F.col("n") - F.size("sigs")
    most = F.col("n") - up(f"bigint(n) * {p}", q) + 1 - alone
    edges = F.array(*[F.lit(e) for e in _partitions(share)])
    entries = sets.select(
        "id", "n", F.size(F.filter(edges, lambda e: e <= F.col("n"))).alias("part"), alone.alias("alone"),
        F.posexplode(F.slice("sigs", F.lit(1), most)).alias("at", "sig"),
    )
    entries = entries.select("id", "n", "part", "sig", (F.col("n") - F.col("alone") - F.col("at")).alias("left"))
    low = entries.select(
        F.col("id").alias("x"), F.col("n").alias("nx"), F.col("left").alias("lx"), "sig", F.explode(F.expr("array(part, part + 1)")).alias("part")
    )
    high = entries.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("left").alias("ly"), "sig", "part")
    met = low.join(high, ["sig", "part"]).filter("nx < ny or (nx = ny and x < y)").filter(f"bigint(nx) * {q} >= bigint(ny) * {p}")
    met = met.filter(F.least("lx", "ly") >= up(f"bigint(nx + ny) * {p}", p + q)).select("x", "y").distinct()
    xs = sets.select(F.col("id").alias("x"), F.col("rep").alias("rx"), F.col("n").alias("nx"), F.col("sigs").alias("sx"))
    ys = sets.select(F.col("id").alias("y"), F.col("rep").alias("ry"), F.col("n").alias("ny"), F.col("sigs").alias("sy"))
    pairs = met.join(xs, "x").join(ys, "y")
    pairs = pairs.select("rx", "ry", _compared(F.col("sx"), F.col("sy"), F.col("nx"), F.col("ny"), at_least).alias("near"))
    pairs = pairs.filter(F.col("near") >= at_least).select(F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b"), "near")
    return equal.select("a", "b", F.lit(1.0).alias("near")).unionAll(pairs)


_LIST = ", ".join(f"'{w}'" for w in ANCHORS)
SQL = f"""
with base as (
  select doc_id, coalesce(text, '') t from documents
), ring as (
  select doc_id, t, coalesce(lead(t) over (order by doc_id, t), first_value(t) over (order by doc_id, t)) nt from base
), edits as (
  select doc_id, t, nt, left(t, (length(t) - length(t) // 4)::integer) || left(nt, (length(t) // 4)::integer) e from ring
), texts as (
  select distinct x from (select t x from edits union all select e x from edits)
), forms as (
  select x, ' ' || trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' form
  from texts
), words as (
  select x, unnest(string_split(trim(form), ' ')) w, generate_subscripts(string_split(trim(form), ' '), 1) i from forms
), flagged as (
  select *, w in ({_LIST}) common from words
), content as (
  select x, i, w, lead(i) over (partition by x order by i) i2, lead(w) over (partition by x order by i) w2 from flagged where not common
), ahead as (
  select x, i, w, common, min(case when not common then i end) over (partition by x order by i rows between 1 following and unbounded following) j
  from flagged
), spots as (
  select ahead.x, left(md5(ahead.w || ' ' || content.w || ' ' || content.w2 || ' '), 12) s
  from ahead join content on ahead.x = content.x and content.i = ahead.j
  where ahead.common and ahead.j - ahead.i - 1 <= {PASSED} and content.i2 - content.i - 1 <= {PASSED}
), sets as (
  select forms.x, coalesce(list_sort(list(distinct s) filter (s is not null)), ['w' || left(md5(any_value(form)), 11)]) s
  from forms left join spots on forms.x = spots.x group by forms.x
)
select doc_id, length(t)::bigint n_chars, sha256(e) edited_sha256, array_to_string(a.s, ',') fingerprint,
  array_to_string(b.s, ',') edited_fingerprint,
  len(list_intersect(a.s, b.s))::double / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) near_edited,
  len(list_intersect(a.s, c.s))::double / (len(a.s) + len(c.s) - len(list_intersect(a.s, c.s))) near_next
from edits join sets a on a.x = t join sets b on b.x = e join sets c on c.x = nt
"""

PAIRS_SQL = f"""
with texts as (
  select distinct doc_id, coalesce(text, '') t from documents where doc_id is not null
), forms as (
  select t, ' ' || trim(regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' form
  from (select distinct t from texts)
), words as (
  select t, unnest(string_split(trim(form), ' ')) w, generate_subscripts(string_split(trim(form), ' '), 1) i from forms
), content as (
  select t, i, w, lead(w) over (partition by t order by i) w2 from words where w not in ({_LIST})
), ahead as (
  select t, i, w, min(case when w not in ({_LIST}) then i end) over (partition by t order by i rows between 1 following and unbounded following) j
  from words
), spots as (
  select distinct ahead.t, ahead.w || ' ' || content.w || ' ' || content.w2 s
  from ahead join content on ahead.t = content.t and content.i = ahead.j
  where ahead.w in ({_LIST}) and content.w2 is not null
), sets as (
  select forms.t, coalesce(string_agg(s, ',' order by s), 'alone' || any_value(form)) s
  from forms left join spots on forms.t = spots.t group by forms.t
), named as (
  select doc_id, s, min(doc_id) over (partition by s) rep from texts join sets on texts.t = sets.t
), own as (
  select s, any_value(rep) rep, string_split(s, ',') l from named group by s
), each as (
  select s, unnest(l) g from own
), met as (
  select x.s xs, y.s ys, count(*) n from each x join each y on x.g = y.g and x.s < y.s group by all
), near as (
  select least(x.rep, y.rep) a, greatest(x.rep, y.rep) b, n::double / (len(x.l) + len(y.l) - n) near
  from met join own x on met.xs = x.s join own y on met.ys = y.s
)
select distinct rep a, doc_id b, 1.0::double near from named where rep <> doc_id
union all select a, b, near from near where near >= {NEAR}
"""
