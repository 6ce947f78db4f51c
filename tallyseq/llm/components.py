"""Connected components of a link table, by contraction on reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long): root is the least node reachable.

    Each round every node points to its least neighbour (found by an aggregate, so a node with very many links costs a
    row a partition), pointers are followed to their ends by jumping, and the links are drawn between the ends
    alone. What is left of them shrinks by half at least, and dense groups vanish in the first round. Only whether
    anything is left reaches the driver. No links give no rows.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    edges = cut(links.where("a != b").select(a.alias("a"), b.alias("b")).distinct())
    labels = None
    while edges.limit(1).count():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        roots = cut(ends.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")))
        while True:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = cut(roots.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            if not roots.where("moved").limit(1).count():
                break
            roots = roots.select("node", "root")
        roots = roots.select("node", "root")
        if labels is None:
            labels = roots
        else:
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = cut(labels.join(above, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        low = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        high = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = edges.join(low, "a").join(high, "b").where("ra != rb")
        edges = cut(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels
