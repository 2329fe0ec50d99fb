"""Main text of web pages as a maximum-scoring subsequence.

A page is read once into tags and words. Words score by the block they stand in, tags cost, both by weights from labelled pages: those
with one article (or main) element, where what is inside is the text. One linear scan finds the contiguous region with the highest
score. Elements that are never text (menus, forms, scripts and the like, by their names, roles and class names) score nothing inside and
give no text, wherever they stand; an element that holds the article, or most of the page's letters, is not taken for one of them.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space, names of HTML elements by what they are, and the words in class names, ids and roles that tell what is no text
SPACE = " \t\n\x0b\x0c\r"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td textarea tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
NEVER = frozenset(
    "applet aside audio button canvas datalist dialog footer form head header iframe map menu nav noembed noframes noscript object script "
    "search select style svg template textarea title video".split()
)
NEVER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
NEVER_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising aside banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disqus footer footers form gdpr header headers login masthead menu menus modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination popup promo promotion recommended related replies respond search share sharing "
    "sidebar sidebars signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
TEXT_NAMES = frozenset("article content entry post story".split())

# Words in a block of which links have more than this share are words of links.
LINKS = 0.5
# Weights stay within these bounds, and features seen less often than this lean to their priors.
MOST = 2.0
PRIOR = 20.0
# A tag costs this besides what labelled pages say of it.
TAG = 0.1
# Labelled pages the weights are learned from, about.
LABELLED = 20_000

_ATTRIBUTES = re.compile(r"""(?>"[^"]*"|'[^']*'|[^'">])*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_NAMED = re.compile(r"""(?<![^\s"'/])(class|id|role|aria-hidden|style|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACES = re.compile(f"[{SPACE}]+")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}


def _kind(name: str, attributes: str) -> str:
    """``never``, ``named`` (by its class, id or role), ``headed`` (a header of a text) or nothing."""
    if name in ("html", "body", "article", "main"):
        names = _names(attributes)[0] if name == "article" else set()
        return "named" if names & NEVER_NAMES and not names & TEXT_NAMES else ""
    names, roles, hidden = _names(attributes)
    if hidden or roles & NEVER_ROLES:
        return "named"
    if name in NEVER:
        return "headed" if name == "header" else "never"
    if names & NEVER_NAMES:
        return "headed" if names & TEXT_NAMES and names & {"header", "headers"} else "" if names & TEXT_NAMES and "body" in names else "named"
    return ""


def _names(attributes: str) -> tuple[set[str], set[str], bool]:
    names, roles, hidden = set(), set(), False
    if "=" not in attributes and "hidden" not in attributes:
        return names, roles, hidden
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            names.update(part.lower() for part in _PARTS.findall(value))
        elif key == "role":
            roles.add(value.lower())
        elif key == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        else:
            hidden |= key == "hidden" or value.lower() == "true"
    return names, roles, hidden


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, content)``: ``open`` and ``close`` tags in lower case with attributes, and ``text``; in one pass over the page.

    Comments and declarations are passed over. What stands in scripts and the like is no markup and, but for a text area, no text. A tag
    without an end takes the rest of the page, as browsers have it.
    """
    at, quoted = 0, True
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = len(page) if end < 0 else end + 3
            continue
        closing = page.startswith("/", lt + 1)
        name = _NAME.match(page, lt + 1 + closing)
        if name is None:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = len(page) if end < 0 else end + 1
            else:
                yield "text", "", "<"
                at = lt + 1
            continue
        rest = _ATTRIBUTES.match(page, name.end()) if quoted else None
        if rest is None:  # a quote that is never closed; from here on quotes are nothing special
            quoted = False
        end = rest.end() if rest else page.find(">", name.end()) + 1
        if not end:
            return
        tag, attributes = name.group().lower(), page[name.end() : end - 1]
        at = end
        if closing:
            yield "close", tag, ""
            continue
        yield "open", tag, attributes
        if tag in RAW:
            stop = _RAW_END[tag].search(page, end)
            at = stop.start() if stop else len(page)


def _feature(tag: str, closing: bool) -> str:
    known = tag if tag in BLOCKS or tag in INLINE else "other"
    return f"</{known}>" if closing else f"<{known}>"


class Page:
    """A page as a list of units in order: tags with their features, and stretches of text with their block."""

    def __init__(self, page: str):
        self.units: list[tuple[str, int, str]] = []  # (tag feature, -1, "") or ("", block, text)
        self.blocks: list[str] = []  # name of the element a block stands in
        self.link_letters: list[int] = []
        self.letters: list[int] = []
        self._spans: list[tuple[int, int, str, int, bool]] = []  # units from, to, kind, letters inside, holds an article
        self.articles: list[tuple[int, int]] = []
        self._read(page)
        self._judge()

    def _read(self, page: str) -> None:
        stack: list[list] = []  # name, kind, first unit, letters before, holds an article
        opened: dict[str, int] = defaultdict(int)
        units, block, total, in_link = self.units, -1, 0, 0

        def close_last() -> None:
            nonlocal in_link
            name, kind, first, before, holds = stack.pop()
            opened[name] -= 1
            if name == "a":
                in_link -= 1
            if name in ("article", "main") and not kind:
                self.articles.append((first, len(units)))
            if kind:
                self._spans.append((first, len(units), kind, total - before, holds))

        for kind, name, content in tokens(page):
            if kind == "text":
                text = entities.unescape(content)
                if block < 0:
                    if not text.strip(SPACE):
                        continue
                    block = len(self.blocks)
                    self.blocks.append(next((entry[0] for entry in reversed(stack) if entry[0] in BLOCKS), ""))
                    self.letters.append(0)
                    self.link_letters.append(0)
                units.append(("", block, text))
                size = len(text)
                total += size
                self.letters[block] += size
                if in_link:
                    self.link_letters[block] += size
                continue
            if name in BLOCKS:
                block = -1
            if kind == "close":
                if opened[name]:
                    while stack[-1][0] != name:
                        close_last()
                    units.append((_feature(name, True), -1, ""))
                    close_last()
                else:
                    units.append((_feature(name, True), -1, ""))
                continue
            what = _kind(name, content)
            units.append((_feature(name, False), -1, ""))
            if name in VOID or content.endswith("/") and name not in BLOCKS and name not in INLINE:
                continue
            if name == "p" or name == "li":  # closed by the next of its kind in most pages
                if stack and stack[-1][0] == name:
                    close_last()
            if name in ("article", "main") and not what:
                for entry in stack:
                    entry[4] = True
            stack.append([name, what, len(units) - 1, total, False])
            opened[name] += 1
            if name == "a":
                in_link += 1
        while stack:
            close_last()
        self.total = total

    def _judge(self) -> None:
        """Which units are inside of elements that are no text."""
        self.outer: list[tuple[int, int]] = []
        for first, last in sorted(self.articles):  # elements lie in one another or apart
            if not self.outer or last > self.outer[-1][1]:
                self.outer.append((first, last))
        begins = [first for first, _ in self.outer]
        hidden, heads = [0] * (len(self.units) + 1), [0] * (len(self.units) + 1)
        texts = [0, *accumulate(block >= 0 for _, block, _ in self.units)]
        for first, last, kind, letters, holds in self._spans:
            if holds or kind == "named" and 2 * letters > self.total:
                continue
            # The header an article begins with has its headings.
            at = bisect(begins, first) - 1
            heading = kind == "headed" and at >= 0 and last <= self.outer[at][1] and texts[begins[at]] == texts[first]
            marks = heads if heading else hidden
            marks[first] += 1
            marks[last] -= 1
        self.skipped, deep, headed = [], 0, 0
        for i, (_, block, _) in enumerate(self.units):
            deep += hidden[i]
            headed += heads[i]
            self.skipped.append(deep > 0 or headed > 0 and not (block >= 0 and self.blocks[block] in HEADINGS))

    @property
    def article(self) -> tuple[int, int] | None:
        """Units of the only article, the label of a page."""
        return self.outer[0] if len(self.outer) == 1 else None

    def features(self) -> Iterator[tuple[int, str, int]]:
        """``(unit, feature, words)`` of what is scored; tags have no words."""
        own = self.article
        for i, (tag, block, text) in enumerate(self.units):
            if self.skipped[i]:
                continue
            if tag:
                yield i, tag, 0
            else:
                words = len(text.split())
                if words:
                    linked = self.link_letters[block] > LINKS * self.letters[block]
                    beyond = own is not None and not own[0] <= i < own[1]
                    yield i, f"{'beyond ' if beyond else ''}{'link' if linked else 'word'} {self.blocks[block]}", words

    def text(self, first: int, last: int) -> str:
        """Blocks with a unit from ``first`` to ``last`` that are text, whole."""
        parts: dict[int, list[str]] = {}
        wanted = {b for i, (_, b, _) in enumerate(self.units[first:last], first) if b >= 0 and not self.skipped[i]}
        for i, (_, block, text) in enumerate(self.units):
            if block in wanted and not self.skipped[i]:
                parts.setdefault(block, []).append(text)
        lines = (_SPACES.sub(" ", "".join(p)).strip(SPACE) for p in parts.values())
        return "\n".join(line for line in lines if line)


def prior(feature: str) -> tuple[float, float]:
    """Shares inside and outside that a feature is thought to have before any page is seen."""
    if feature.startswith("<"):
        return 0.5, 0.5
    if feature.startswith("beyond"):
        return 0.02, 0.98
    return (0.15, 0.85) if feature.startswith("link") else (0.9, 0.1)


class Weights:
    """Score of a word or tag by its feature: log odds of being inside the text, at most 0 for tags, and a fixed cost for these."""

    def __init__(self, counts: dict[str, tuple[float, float]]):
        self.counts, self.known = counts, {}

    def __getitem__(self, feature: str) -> float:
        if feature not in self.known:
            inside, outside = self.counts.get(feature, (0, 0))
            share_in, share_out = prior(feature)
            odds = math.log((inside + PRIOR * share_in) / (outside + PRIOR * share_out))
            odds = max(-MOST, min(MOST, odds))
            self.known[feature] = min(0.0, odds) - TAG if feature.startswith("<") else odds
        return self.known[feature]


def best_region(scores: list[float]) -> tuple[int, int]:
    """Ends of the contiguous part with the highest sum, the first of equal ones; empty if none is positive."""
    best, ends, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, ends = total, (start, i + 1)
    return ends


def main_text(page: str, weights: Weights) -> str:
    read = Page(page)
    scored = list(read.features())
    first, last = best_region([weights[feature] * (words or 1) for _, feature, words in scored])
    return read.text(scored[first][0], scored[last - 1][0] + 1) if last > first else ""


def label_counts(pages: list[str]) -> dict[str, list[int]]:
    """``feature -> [inside, outside]`` over the labelled ones of ``pages``."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for page in pages:
        read = Page(page)
        if read.article is None:
            continue
        first, last = read.article
        for i, feature, words in read.features():
            # The tags of the article itself are its border, not inside.
            counts[feature][0 if first < i < last - 1 else 1] += words or 1
    return counts


def train(pages: DataFrame, html: str = "html", labelled: int = LABELLED) -> Weights:
    """Weights from about ``labelled`` of the pages that have an article, drawn by a hash of the page.

    One row per feature comes to the driver; features are made of names of HTML elements, so these are some hundred at most.
    """
    page = F.col(html).cast("string")
    candidates = pages.filter(F.contains(F.lower(page), F.lit("<article")) | F.contains(F.lower(page), F.lit("<main")))
    number = candidates.count()
    place = F.pmod(F.xxhash64(page), F.lit(1 << 30)) / float(1 << 30)
    drawn = candidates.filter(place < min(1.0, labelled / max(number, 1))).select(page.alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for value in batch.column(0):
                for feature, (inside, outside) in label_counts([value.as_py()]).items():
                    total[feature][0] += inside
                    total[feature][1] += outside
        rows = sorted(total.items())
        columns = [pa.array([k for k, _ in rows], pa.string()), *(pa.array([v[j] for _, v in rows], pa.int64()) for j in (0, 1))]
        yield pa.record_batch(columns, ["feature", "inside", "outside"])

    sums = drawn.mapInArrow(count, "feature string, inside long, outside long").groupBy("feature")
    return Weights({r[0]: (r[1], r[2]) for r in sums.agg(F.sum("inside"), F.sum("outside")).collect()})


def extract(pages: DataFrame, weights: Weights | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text`` of every row of ``pages``.

    Without ``weights`` they are learned from ``pages`` first. Character references are decoded, white space in a block is one space,
    blocks are joined by one line feed. A null or empty page, and one without words, gives an empty text; pages are read whole however
    long; a null key or url is kept; repeated rows give repeated rows. Other columns are not read; an empty table gives an empty one.
    """
    weights = weights or train(pages, html)
    counts = weights.counts

    def texts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Weights(counts)
        for part in parts:
            yield pa.array([main_text(page.as_py() or "", own) for page in part], pa.string())

    return pages.select(F.col(key).alias(key), F.col(url).alias(url), F.arrow_udf("string")(texts)(F.col(html).cast("string")).alias("text"))
