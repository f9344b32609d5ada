"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any orientation, repeats and loops allowed -> (node, component): the smallest node reachable.

    Each step sends a node's neighbours to the smallest of them. Minima are found by aggregation and written, so the joins
    with them have exchanges of their own, which adaptive execution splits at a node with many neighbours. Ends when a step changes nothing; the number of steps grows with the logarithm of
    the number of nodes. Nulls are dropped. Nodes without an edge to another node are not listed.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct(), "large")
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("s"))
        new = cut(small.select(F.col("s.x").alias("a"), F.col("s.y").alias("b")).where("a <> b").distinct(), "edges")
        # a fixed point is a forest of stars: no node is both a leaf and a centre, and no leaf has two centres
        bad = new.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count()
        if not bad and not new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count():
            break
        e = new
    stars = new.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
