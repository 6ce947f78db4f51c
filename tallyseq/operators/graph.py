"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component, the least node that can be reached, of every node that has an edge to another.

    Each round hangs a node's greater neighbours on its least one, then its lesser ones; trees flatten in a number of rounds that grows with the
    logarithm of the longest path. Minima are aggregates and rows move by joins, so no node's neighbours meet in one place.
    """
    links = settle(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settle(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        # a round that changes nothing leaves each node one link, to a root that has none
        if not after.join(links, ["u", "v"], "left_anti").limit(1).count() and not links.join(after, ["u", "v"], "left_anti").limit(1).count():
            break
        links = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
