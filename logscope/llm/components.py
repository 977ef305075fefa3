"""Connected components of an edge table, by least labels with pointer jumping.

Every round is two joins and one aggregation over tables that Spark partitions;
labels are written to the shared checkpoint folder each round, so lost
executors cost one round at most. A hub with very many edges is one
key of the joins' large side, which adaptive execution splits; the aggregation
is combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.session import materialise


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label) for every node of an edge; label is the least node of its component. Null ends are ignored,
    repeated edges and loops do no harm; nodes without edges are not listed."""
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    e = materialise(e.union(e.select("v", "u")).distinct())
    labels = materialise(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_m")).select("node", F.least("node", "_m").alias("label")))
    while True:
        around = e.join(labels, e["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("_m"))
        hooked = labels.join(around, labels["node"] == around["u"]).select("node", "label", F.least("label", "_m").alias("_m"))
        # pointer jumping: the label's own label
        jump = labels.select(F.col("node").alias("_m"), F.col("label").alias("_j"))
        new = materialise(hooked.join(jump, "_m", "left").select(
            "node", F.least("_m", F.coalesce("_j", "_m")).alias("label"), (F.least("_m", F.coalesce("_j", "_m")) < F.col("label")).alias("_moved")))
        moved = new.where("_moved").limit(1).count()
        labels = new.drop("_moved")
        if not moved:
            return labels
