"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the smallest node reachable.

    Each round sends every node's root over its edges, keeps the smallest, and then replaces each
    root by its own root. Only numbers or keys travel; minima are combined before the shuffle, so a
    node with very many edges costs one row per task. The number of rounds grows with the logarithm
    of the longest path. An empty edge table gives an empty result; self loops give their node.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(both.distinct())
    first = both.groupBy("a").agg(F.min("b").alias("b"))
    labels = staged(first.select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        sent = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "root")
        near = labels.union(sent).groupBy("node").agg(F.min("root").alias("root"))
        near = staged(near)
        jump = near.select(F.col("node").alias("root"), F.col("root").alias("far"))
        nearer = staged(
            near.join(jump, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"))
        )
        changed = nearer.join(labels.withColumnRenamed("root", "was"), "node").where(F.col("root") != F.col("was"))
        labels = nearer
        if changed.isEmpty():
            return labels
