"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(links: DataFrame, scratch) -> DataFrame:
    """(node, component) for the nodes of links (a, b): the smallest node reachable.

    Each step is a partially aggregated minimum by node and a join of two plain
    exchanges; tables are written between steps by ``scratch.keep`` and let go by ``scratch.drop``.
    Steps go on until nothing changes. Self-links are kept out.
    """
    edges = scratch.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.filter("m < a").select("a", F.col("m").alias("b"))
        large = scratch.keep(large.unionByName(own).filter("a <> b").distinct())
        low = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = scratch.keep(small.filter("a <> b").distinct())
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(edges, least, large, low)
        edges = new
        if mark == before:
            break
        before = mark
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
