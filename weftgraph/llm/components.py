"""Connected components by minimum labels, entirely on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); the root is the smallest node reachable.

    Every round takes the least label among the neighbours and then follows it once
    (pointer jumping), so a path of n nodes needs about log n rounds.  Each round is written
    to the shared folder.  Self-loops and repeated edges do no harm.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("root").alias("near"))
        better = label.join(near, label.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("node").alias("via"), F.col("root").alias("far"))
        # the label's own label, from the round before, is at most the label
        new = better.join(jump, better.root == jump.via, "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
        new = stored(new, "labels")
        discard(label)
        label = new.select("node", "root")
        if new.filter("root < old").isEmpty():
            discard(both)
            return label
