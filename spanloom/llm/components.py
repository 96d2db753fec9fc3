"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, join_groups, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v, each once. Large: every larger neighbour of a node is tied to the node's least one; small: every smaller one."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    tied = join_groups(near, least, ["u"], "n", near.count(), F.col("v"))
    if large:
        new = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
    return new.where("u <> v").distinct()


def components(edges: DataFrame, limit: int = 100) -> DataFrame:
    """(node, component): the least node that each node of edges (a, b) is tied to; nodes without edges are left out, as are edges with a null end."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = staged(edges, "cc-edges")
    for _ in range(limit):
        large = staged(_star(edges, large=True), "cc-large")
        new = staged(_star(large, large=False), "cc-small")
        drop_staged(large)
        # done when every node is tied to one node that is tied to none itself: the step then returns its input
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            least = new.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least)
        drop_staged(edges)
        edges = new
    raise RuntimeError("components did not settle")
