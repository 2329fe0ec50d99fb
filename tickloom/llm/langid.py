"""Language ID by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A text's likelihood is the sum, over all ways to
cut it into pieces, of the product of their probabilities; a forward pass adds the ways up place by place. Pieces do not go over
the ends of words, so the likelihood is a product over words, and a worker works out each word once while it remembers it.

Training counts words of a bounded sample of labelled rows per language on Spark, then expects pieces from them (forward and
backward pass) a few times. Language shares come from all labelled rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.held import give_back, held
from tickloom.llm.piecemodel import BYTE, NORMAL, SPACE, read_model
from tickloom.session import materialize

UNKNOWN = "und"

# Labelled rows per language that the piece probabilities are learned from, about.
TRAIN_ROWS = 1500
ROUNDS = 2
# Added to each expected count.
PRIOR = 0.1
# Words a worker remembers, and the longest word it remembers; longer stretches are read this many letters at a time.
CACHE_WORDS = 200_000
CACHE_CHARS = 40
STRETCH = 1 << 12
# Cells (words by their longest) worked out together; characters of texts read together; words of a very long text read together.
CELLS = 1 << 14
PART = 1 << 19
WORDS = 1 << 16

LETTERS = regex.compile(r"\p{L}+")


class Lattice:
    """Pieces of words: where each starts and ends."""

    def __init__(self, model: bytes):
        read = read_model(model)
        self.size = len(read.pieces)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(read.pieces) if read.kinds[i] == BYTE}
        self.lengths = np.array([len(p) for p in read.pieces], np.int64)
        self.matcher = ahocorasick.Automaton()
        for i, p in enumerate(read.pieces):
            # A space stands before a word only, so other pieces with one are in no word.
            if read.kinds[i] == NORMAL and p.strip(SPACE) and SPACE not in p[1:]:
                self.matcher.add_word(p, i)
        self.single = {p for i, p in enumerate(read.pieces) if read.kinds[i] == NORMAL and len(p) == 1}
        self.matcher.make_automaton()

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """``word, start, end, piece`` of all pieces, and ``word, start, byte piece`` for characters that are no piece.

        The words, which have no spaces, are read as one text, a space before each; no piece matches across one.
        """
        text = SPACE + SPACE.join(words)
        found = np.fromiter(chain.from_iterable(self.matcher.iter(text)), np.int64).reshape(-1, 2)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        word = np.repeat(np.arange(len(words)), sizes)[found[:, 0]]
        piece, end = found[:, 1], found[:, 0] - (np.cumsum(sizes) - sizes)[word]
        start = np.maximum(0, end - self.lengths[piece])
        spelled = []
        if not self.single.issuperset(set(text) - {SPACE}):
            for w, one in enumerate(words):
                if not self.single.issuperset(one):
                    spelled += [(w, at, self.bytes[b]) for at, char in enumerate(one) if char not in self.single for b in char.encode()]
        return np.stack([word, start, end, piece]), np.array(spelled, np.int64).reshape(-1, 3).T


def likelihoods(lattice: Lattice, logp: np.ndarray, words: list[str]) -> np.ndarray:
    """Log likelihood of each word, a row per word and a column per language."""
    word, start, end, _, weight = _steps(lattice, logp, words)
    return _ways(words, word, start, end, weight)[np.arange(len(words)), [len(w) for w in words]]


def _steps(lattice: Lattice, logp: np.ndarray, words: list[str]):
    """``word, start, end, piece, log probability`` of all edges; a character spelled by bytes is one edge, with piece -1."""
    (word, start, end, piece), (sword, sat, sbyte) = lattice.edges(words)
    weight = logp[piece]
    if len(sword):
        at, inverse = np.unique(np.stack([sword, sat]), axis=1, return_inverse=True)
        spelled = np.zeros((at.shape[1], logp.shape[1]))
        np.add.at(spelled, inverse.ravel(), logp[sbyte])
        word, start = np.concatenate([word, at[0]]), np.concatenate([start, at[1]])
        end, piece = np.concatenate([end, at[1] + 1]), np.concatenate([piece, np.full(at.shape[1], -1)])
        weight = np.concatenate([weight, spelled])
    return word, start, end, piece, weight


def _ways(words, word, start, end, weight):
    """Forward pass: log of the sum over all ways from a word's start to each of its places."""
    longest = max(map(len, words), default=0)
    order = np.lexsort((word, end))
    word, start, end, weight = word[order], start[order], end[order], weight[order]
    ways = np.full((len(words), longest + 1, weight.shape[1]), -np.inf)
    ways[:, 0] = 0.0
    stops = np.searchsorted(end, np.arange(1, longest + 2))
    for place in range(1, longest + 1):
        s = slice(stops[place - 1], stops[place])
        w = word[s]
        if len(w):
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            ways[w[first], place] = np.logaddexp.reduceat(ways[w, start[s]] + weight[s], first, axis=0)
    return ways


def expected(lattice: Lattice, logp: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, each ``counts`` times, under the probabilities of one language."""
    out = np.zeros(len(logp))
    word, start, end, piece, weight = _steps(lattice, logp[:, None], words)
    lengths = np.array([len(w) for w in words])
    ahead = _ways(words, word, start, end, weight)
    behind = _ways(words, word, lengths[word] - end, lengths[word] - start, weight)  # the same, from the words' ends
    whole = ahead[np.arange(len(words)), lengths]
    through = ahead[word, start] + weight + behind[word, lengths[word] - end] - whole[word]
    share = np.exp(through[:, 0]) * counts[word]
    np.add.at(out, piece[piece >= 0], share[piece >= 0])
    for w, at, many in zip(word[piece < 0], start[piece < 0], share[piece < 0]):
        for b in words[w][at].encode():
            out[lattice.bytes[b]] += many
    return out


def lattice_of(model: bytes) -> Lattice:
    return held(("lattice", hash(model)), lambda: Lattice(model))


def words_of(text: str) -> Iterator[list[str]]:
    """Lower-cased stretches of letters, some at a time; very long ones are cut, so that memory stays bounded."""
    text = text.lower()
    if len(text) <= PART:
        found = LETTERS.findall(text)
        long = len(text) > STRETCH and max(map(len, found), default=0) > STRETCH
        yield [w[i : i + STRETCH] for w in found for i in range(0, len(w), STRETCH)] if long else found
        return
    part = []
    for match in LETTERS.finditer(text):
        part += [match[0][i : i + STRETCH] for i in range(0, len(match[0]), STRETCH)]
        if len(part) >= WORDS:
            yield part
            part = []
    yield part


@dataclass(frozen=True)
class Model:
    """Log probabilities of the learned languages: shares, and pieces by languages; and the vocabulary file's content."""

    languages: list[str]
    prior: np.ndarray
    logp: np.ndarray
    vocabulary: bytes
    name: str


class Scorer(dict):
    """Places of words in a table of log likelihoods; unseen words are added, up to a bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.lattice = model, Lattice(model.vocabulary)
        self.table = np.zeros((1024, len(model.languages)))

    def scores(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Log likelihood and share by language; None for texts without letters, and where no language is known."""
        if not self.model.languages:
            yield from [None] * len(texts)
            return
        short = [list(words_of(text)) if text and len(text) <= PART else None for text in texts]
        self.learn([w for parts in short if parts for words in parts for w in words])
        for text, parts in zip(texts, short):
            total, any_ = self.model.prior.copy(), False
            for words in parts or (words_of(text) if text else ()):
                any_ |= bool(words)
                known = list(map(self.get, words))
                if None in known:  # of a long text, too long to keep, or let go for others
                    self.learn(words)
                    for word in words:
                        if len(word) > CACHE_CHARS:
                            total += likelihoods(self.lattice, self.model.logp, [word])[0]
                    known = [self[w] for w in words if len(w) <= CACHE_CHARS]
                total += self.table[np.array(known, np.int64)].sum(axis=0)
            yield total if any_ else None

    def learn(self, words: list[str]) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
        new = sorted(w for w in set(words) if w not in self and len(w) <= CACHE_CHARS)
        new.sort(key=len)
        for places in parts_of(new, list(range(len(new)))):
            part, size = [new[i] for i in places], len(self)
            while size + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[size : size + len(part)] = likelihoods(self.lattice, self.model.logp, part)
            self.update(zip(part, range(size, size + len(part))))


def scorer_of(model: Model) -> Scorer:
    """A worker's scorer, kept between tasks."""
    return held(("scorer", model.name), lambda: Scorer(model))


def parts_of(words: list[str], order: list[int]) -> Iterator[list[int]]:
    """``order`` of words, sorted by length, in parts whose tables are of bounded size whatever the words' lengths."""
    part: list[int] = []
    for i in order:
        if part and (len(part) + 1) * (len(words[i]) + 1) > CELLS:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def train(
    docs: DataFrame, path: str, rows: int = TRAIN_ROWS, rounds: int = ROUNDS, key: str = "doc_id", text: str = "text",
    lang: str = "lang",
) -> Model:
    """Learn from the rows of ``docs`` with a language; null and empty texts teach nothing.

    Probabilities come from about ``rows`` rows per language, drawn by a hash of the key; shares of languages from all rows.
    What is kept on the driver is a table of pieces by languages.
    """
    with open(path, "rb") as file:
        content = file.read()
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    labelled = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    sizes = {r.l: r.n for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes, key=lambda name: name.encode())
    if not languages:
        return Model([], np.zeros(0), np.zeros((0, 0)), content, uuid.uuid4().hex)
    lattice = lattice_of(content)
    prior = np.log(np.array([sizes[name] for name in languages]) / sum(sizes.values()))
    share = F.element_at(F.create_map(*[x for n in languages for x in (F.lit(n), F.lit(min(1.0, rows / sizes[n])))]), F.col("l"))
    place = (F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30))
    sample = labelled.filter(place < share).select("l", "t")
    shared = sample.sparkSession.sparkContext.broadcast(content)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for name, one in zip(batch.column("l").to_pylist(), batch.column("t")):
                for words in words_of(one.as_py()):
                    found.setdefault(name, Counter()).update(words)
            for name, words in found.items():
                yield pa.record_batch(
                    [pa.array([name] * len(words)), pa.array(list(words)), pa.array(words.values(), pa.int64())], ["l", "w", "n"]
                )

    words = sample.mapInArrow(count, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    words = materialize(words)
    logp = np.full((lattice.size, len(languages)), -np.log(lattice.size))
    for _ in range(rounds):
        now = words.sparkSession.sparkContext.broadcast(logp)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, logp = lattice_of(shared.value), now.value
            total = np.zeros(logp.shape)
            for batch in batches:
                names, texts = batch.column("l").to_pylist(), batch.column("w").to_pylist()
                order = sorted(range(len(texts)), key=lambda i: (names[i], len(texts[i])))
                for name, own in groupby(order, key=names.__getitem__):
                    one, own = languages.index(name), list(own)
                    for part in parts_of(texts, own):
                        many = batch.column("n").to_numpy()[part]
                        total[:, one] += expected(lattice, logp[:, one], [texts[i] for i in part], many)
            piece, language = np.nonzero(total)
            yield pa.record_batch([pa.array(piece), pa.array(language), pa.array(total[piece, language])], ["p", "l", "e"])

        sums = words.mapInArrow(expect, "p long, l long, e double").groupBy("p", "l").agg(F.sum("e").alias("e")).toArrow()
        total = np.full(logp.shape, PRIOR)
        total[sums.column("p").to_numpy(), sums.column("l").to_numpy()] += sums.column("e").to_numpy()
        logp = np.log(total / total.sum(axis=0))
    return Model(languages, prior, logp, content, uuid.uuid4().hex)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the share of the chosen language in the likelihood of all.

    A null text and one without letters are ``und`` with score 0, and so is every text if no language was learned. Ties go to
    the first language in code point order. Columns of these two names are replaced; repeated rows and an empty table come
    back as they are. Very long texts are read whole, some words at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = scorer_of(shared.value)
        for batch in batches:
            names, shares, part, size = [], [], [], 0
            for i, one in enumerate(batch):
                part.append(one.as_py())
                size += len(part[-1] or "")
                if size < PART and i + 1 < len(batch):
                    continue
                for scores in scorer.scores(part):
                    if scores is None:
                        names.append(UNKNOWN)
                        shares.append(0.0)
                    else:
                        best = int(np.argmax(scores))
                        names.append(scorer.model.languages[best])
                        shares.append(float(1.0 / np.exp(scores - scores[best]).sum()))
                part, size = [], 0
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["lang", "score"])
        give_back()

    found = docs.withColumn("_found", F.arrow_udf("lang string, score double")(choose)(F.col(text).cast("string")))
    return found.withColumns({"lang_pred": F.col("_found.lang"), "score": F.col("_found.score")}).drop("_found")
