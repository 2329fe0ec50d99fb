"""Connected components of links, by rounds of joins on checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable over ``links`` (columns ``a``, ``b``), for every node of a link.

    Each round hangs every node's larger neighbours, and then the node and its smaller ones, under the smallest of them; stars
    are left when nothing changes. Neighbours are never gathered: a round is a minimum per node, combined before the shuffle,
    and a join with it, whose hot nodes Spark splits.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges)
    last = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.filter("u > v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    stars = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
    return stars.unionAll(roots).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("component"))
