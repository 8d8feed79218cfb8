"""Diagnostics of raw edges before they are collapsed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_diagnostics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counters: missing, dangling, loops, valid, and what a collapse would lose."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    e = edges.join(ids, F.col("src") == F.col("_id"), "left").withColumn("_s", F.col("_id").isNotNull()).drop("_id")
    e = e.join(ids, F.col("dst") == F.col("_id"), "left").withColumn("_d", F.col("_id").isNotNull()).drop("_id")
    missing = F.col("src").isNull() | F.col("dst").isNull()
    valid = ~missing & F.col("_s") & F.col("_d")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))
    top = e.agg(F.count(F.lit(1)).alias("total"), n(missing).alias("missing_endpoint"), n(~missing & ~(F.col("_s") & F.col("_d"))).alias("dangling"), n(F.col("src") == F.col("dst")).alias("self_loops"), n(valid).alias("valid"))
    good = e.filter(valid)
    exact = good.groupBy("src", "dst", "relation", "confidence", "context", "source_file").agg(F.count(F.lit(1)).alias("c"))
    dups = exact.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("exact_duplicates"))
    both = good.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))
    directed = both.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("directed_collapse"))
    pairs = both.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("c").alias("c"))
    undirected = pairs.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("undirected_collapse"))
    return top.join(F.broadcast(dups)).join(F.broadcast(directed)).join(F.broadcast(undirected))


def same_endpoint_groups(edges: DataFrame, top: int = 10) -> DataFrame:
    """Directed pairs with several edges, and how these differ; the largest groups first."""
    by = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("edges"), *(F.countDistinct(F.coalesce(c, F.lit(""))).alias(n) for c, n in (("relation", "relations"), ("confidence", "confidences"), ("source_file", "files"), ("context", "contexts"))))
    return by.filter("edges > 1").orderBy(F.desc("edges"), "src", "dst").limit(top)
