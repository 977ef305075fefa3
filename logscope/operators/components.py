"""Connected components of an edge table: alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` pairs of node ids -> ``(id, comp)``: each node that has an edge, with the least id of its component.

    Every step is an aggregate by node and a join with its result; a hub is one group of a combined aggregate, and its join rows are split by
    adaptive execution. The number of steps grows with the logarithm of the longest path. Loops and repeated pairs change nothing; an
    empty table gives an empty result."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # large star: greater neighbours hang on the least node around
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours hang on the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one node at most, and on none if something hangs on it."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()
