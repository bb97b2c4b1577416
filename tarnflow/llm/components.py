"""Connected components of a graph of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes that links join; a component is known by its least node.

    Large-star and small-star steps in turn, each an aggregation by minimum (combined before its shuffle), written, and a
    join with it that adaptive execution splits where a node has very many links, until all links point at the least node of
    their component.  Links that tell nothing are dropped on the way; the number of rounds grows with the logarithm of the
    longest path.  Null ends and loops are ignored.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct(), "links")
    while not _all_stars(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        # Large star: neighbours above a node are linked with the node's least neighbour instead.
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        # Small star: a node and its neighbours below it are linked with the least of these.
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(small.unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        discard(old, least, large, low)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select("v", "v").distinct())


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node points at one other at most, and at none if it is pointed at."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("is_pointed_at")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("is_pointed_at").alias("is_pointed_at")).where("points > 1 or points > 0 and is_pointed_at > 0").isEmpty()


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component), as ``components`` gives, of what groups (node, component) and more links (a, b) join."""
    ends = links
    for end in "ab":
        ends = ends.join(groups.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    joined = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))).select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = groups.join(joined, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    fresh = joined.join(groups, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return written(moved.unionAll(fresh), "groups")
