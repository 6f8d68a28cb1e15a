"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a long, b long): the smallest node reachable.

    Each round links the larger neighbours of a node, then the smaller ones, to the smallest
    neighbour; the rounds grow with the logarithm of the longest path. A node with very many
    neighbours is only ever aggregated to its minimum and joined, never gathered.
    """
    links = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        # Finished when every link leads to a node without a smaller neighbour.
        roots = small.select(F.col("v").alias("u")).distinct().join(small.select("u").distinct(), "u", "left_semi")
        more = small.groupBy("u").count().filter("count > 1").select("u")
        if roots.union(more).isEmpty():
            nodes = small.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.union(small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        links = small
