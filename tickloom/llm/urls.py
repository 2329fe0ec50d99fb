"""URL filter: rules by host and path, and gradient-boosted trees on lexical features where no rule speaks.

URLs that a rule judges are the labelled ones the trees are trained on. Features are lengths, depth, digit ratio, entropy,
parameter counts and, for the ending of the host and the first folder of the path, the share of blocked ones among the labelled
URLs with the same. Everything is columns and Spark's own trees.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import materialize, small_side

ALLOW, BLOCK = "allow", "block"

# Labelled URLs the trees are trained on, about; statistics of suffixes and folders are over all of them.
TRAIN_ROWS = 50_000
TREES = 8
DEPTH = 4
# Labelled URLs that weigh as much as the overall share in the statistics of a suffix or folder.
SMOOTHING = 20.0

FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "host_depth", "path_depth", "digit_ratio", "other_ratio", "entropy",
    "parameters", "has_fragment", "secure", "suffix_share", "folder_share",
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host, then a path from its first slash on

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Text of the longest rule that fits; null if none does."""
    longest_first = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [
        (((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), F.lit(r.text))
        for r in longest_first
    ]
    return F.coalesce(*[F.when(fit, text) for fit, text in fits], F.lit(None).cast("string"))


def judged(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, url, host, path, rule, ruled``: the verdict of the rules, null where none fits."""
    rows = pages.select(F.col(key).alias(key), F.col(url).cast("string").alias("url"))
    rows = rows.select(key, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = reduce(lambda c, r: c.when(F.col("rule") == r.text, r.verdict), rules[1:], F.when(F.col("rule") == rules[0].text, rules[0].verdict))
    return rows.withColumn("ruled", by_rule)


def lexical(rows: DataFrame) -> DataFrame:
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    size = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    # One term per distinct character, counted by taking it out.
    chars = F.array_distinct(F.split(url, ""))
    entropy = F.aggregate(
        F.transform(chars, lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size), F.lit(0.0),
        lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0),
    )
    return rows.withColumns({
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "host_depth": F.regexp_count(host, F.lit(r"\.")), "path_depth": F.regexp_count(path, F.lit("/")),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / size,
        "other_ratio": F.regexp_count(url, F.lit("[^A-Za-z0-9]")) / size,
        "entropy": entropy,
        "parameters": F.regexp_count(query, F.lit("[^&]+")),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"), "secure": F.startswith(url, F.lit("https")).cast("int"),
        "suffix": F.substring_index(host, ".", -1), "folder": F.get(F.split(path, "/"), F.lit(1)),
    }).fillna("", ["suffix", "folder"])


class Shares:
    """Share of blocked URLs by host ending and by first folder, among the labelled."""

    def __init__(self, labelled: DataFrame, overall: float):
        self.overall = overall
        self.tables = {
            name: small_side(
                labelled.groupBy(by).agg(
                    ((F.sum("label") + SMOOTHING * overall) / (F.count("*") + SMOOTHING)).alias(name)
                )
            )[0]
            for name, by in self.by.items()
        }

    by = {"suffix_share": "suffix", "folder_share": "folder"}

    def attach(self, rows: DataFrame) -> DataFrame:
        for name, by in self.by.items():
            rows = rows.join(self.tables[name], by, "left")
        return rows.fillna(self.overall, list(self.by))


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(
        rows.withColumns({name: F.col(name).cast("double") for name in FEATURES})
    )


def train(labelled: DataFrame, shares: Shares, rows: int, sizes: int) -> GBTClassificationModel:
    share = min(1.0, rows / sizes)
    place = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) / float(1 << 30)
    sample = _vectors(shares.attach(labelled.filter(place < share))).select("_features", F.col("label").cast("double"))
    trees = GBTClassifier(
        featuresCol="_features", labelCol="label", predictionCol="_blocked", maxIter=TREES, maxDepth=DEPTH, seed=1,
    )
    return trees.fit(materialize(sample))


def filter_urls(
    pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", rows: int = TRAIN_ROWS
) -> DataFrame:
    """``key, host, path, rule, verdict`` of every row.

    A null URL and one without ``://`` have an empty host and path and are judged by the trees. The trees learn from about
    ``rows`` of the URLs that a rule judges, drawn by a hash of the URL. If all of these have one verdict, the rest get it too;
    without any the rest are allowed. Repeated rows are judged one by one; an empty table gives an empty one; other columns
    are not read.
    """
    ruled = judged(pages, rules, key, url)
    labelled = ruled.filter("ruled is not null").select("url", "host", "path", (F.col("ruled") == BLOCK).cast("int").alias("label"))
    sizes = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    if not sizes.n or sizes.blocked in (0, sizes.n):
        other = F.lit(BLOCK if sizes.n and sizes.blocked else ALLOW)
        return ruled.select(key, "host", "path", "rule", F.coalesce("ruled", other).alias("verdict"))
    known = lexical(labelled)
    shares = Shares(known, sizes.blocked / sizes.n)
    model = train(known, shares, rows, sizes.n)
    scored = model.transform(_vectors(shares.attach(lexical(ruled))))
    by_trees = F.when(F.col("_blocked") > 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(key, "host", "path", "rule", F.coalesce("ruled", by_trees).alias("verdict"))
