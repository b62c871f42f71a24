"""Connected components of a distributed graph by alternating large-star and small-star steps.

Each step is an aggregation (combined before its shuffle) and a join back, never a list of neighbours, so a node with very
many edges is no list. Both sides of a join come straight from a shuffle, which is the form in which adaptive execution splits the
edges of such a node over tasks. Edges are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _sum(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (u, v) of any orderable type -> u, root: each node that has an edge to another, and its component's least node."""
    edges = scratch.table(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _sum(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.repartition("u"), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.repartition("u"), "u")
        moved = small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.table(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = _sum(new)
        scratch.drop(edges)
        edges = new
        if now == seen:
            break
        seen = now
    return edges.select("u", F.col("v").alias("root"))
