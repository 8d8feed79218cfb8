"""Graph files: node-link JSON, GraphML, versioned tables, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import prefix_graph, score_defaults
from ..store import stored


class ShrinkError(ValueError):
    """The new graph has fewer nodes than the one it would replace."""


def write_tables(nodes: DataFrame, edges: DataFrame, path: str, force: bool = False) -> None:
    """Nodes and edges as Parquet, edges with their default scores; refuses to shrink unless forced."""
    spark = nodes.sparkSession
    if not force:
        try:
            before = spark.read.parquet(f"{path}/nodes").count()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            before = 0
        if nodes.count() < before:
            raise ShrinkError(f"{before} nodes before")
    # what is written may be read from the same place
    n, e = stored(nodes, "sink-nodes"), stored(score_defaults(edges), "sink-edges")
    n.write.mode("overwrite").parquet(f"{path}/nodes")
    e.write.mode("overwrite").parquet(f"{path}/edges")


def node_link_lines(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """(kind, json): a JSON object for each node and link, in the vocabulary of node-link files."""
    n = nodes.withColumn("norm_label", F.lower("label"))
    link = score_defaults(simple).withColumnsRenamed({"src": "source", "dst": "target"}).drop("lo", "hi")
    return n.select(F.lit("node").alias("kind"), F.to_json(F.struct(*n.columns)).alias("json")).union(link.select(F.lit("link"), F.to_json(F.struct(*link.columns))))


def write_node_link(nodes: DataFrame, simple: DataFrame, path: str) -> None:
    """One node-link document, for graphs that fit one task; larger ones are ``node_link_lines``."""
    lines = node_link_lines(nodes, simple)
    doc = lines.groupBy().agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == "node", F.col("json")))), ",\n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == "link", F.col("json")))), ",\n").alias("e"))
    doc.select(F.concat(F.lit('{"directed": false, "multigraph": false, "graph": {}, "nodes": ['), "n", F.lit('],\n"links": ['), "e", F.lit("]}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _xml(c: Column) -> Column:
    t = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def graphml_lines(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """(part, line): lines of a GraphML document in the order of ``part``; community -1 where there is none."""
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), _xml(c), F.lit("</data>"))
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), data("label", F.col("label")), data("source_file", F.col("source_file")), data("community", F.coalesce("community", F.lit(-1))), F.lit("</node>")).alias("line"))
    e = simple.select(F.lit(2), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('">'), data("relation", F.col("relation")), data("confidence", F.col("confidence")), F.lit("</edge>")))
    head = "".join(f'<key id="{k}" for="{t}" attr.name="{k}" attr.type="{"int" if k == "community" else "string"}"/>' for k, t in (("label", "node"), ("source_file", "node"), ("community", "node"), ("relation", "edge"), ("confidence", "edge")))
    edge = nodes.sparkSession.createDataFrame([(0, f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{head}<graph edgedefault="undirected">'), (3, "</graph></graphml>")], "part int, line string")
    return edge.union(n).union(e)


def write_graphml(nodes: DataFrame, simple: DataFrame, path: str) -> None:
    graphml_lines(nodes, simple).repartitionByRange(4, "part").sortWithinPartitions("part").select("line").coalesce(1).write.mode("overwrite").text(path)


def register(nodes: DataFrame, repo: str, path: str) -> None:
    """Nodes of a repository in a registry partitioned by ``repo``; only its own partition is replaced."""
    prefix_graph(nodes, repo).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)


def unregister(spark: SparkSession, repo: str, path: str) -> DataFrame:
    """The registry's nodes without a repository's."""
    return spark.read.parquet(path).filter(F.col("repo") != repo)
