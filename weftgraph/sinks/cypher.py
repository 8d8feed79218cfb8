"""Import statements for a property-graph store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    """A single-quoted literal: control characters go, backslashes and quotes are escaped."""
    clean = F.regexp_replace(c, r"[\x00-\x08\x0A-\x1F]", "")
    return F.concat(F.lit("'"), F.replace(F.replace(clean, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def _name(c: Column, other: str) -> Column:
    """An identifier: letters, digits and underscores, a letter first; else ``other``."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_]", "")
    return F.when(clean.rlike("^[A-Za-z]"), clean).otherwise(other)


def statements(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """(statement): one for each node, one for each pair."""
    kind = F.coalesce("file_type", F.lit("unknown"))
    kind = _name(F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 1000))), "Entity")
    node = F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: "), _text(F.col("id")), F.lit(", label: "), _text(F.coalesce("label", "id")), F.lit("});"))
    edge = F.concat(F.lit("MATCH (a {id: "), _text(F.col("src")), F.lit("}), (b {id: "), _text(F.col("dst")), F.lit("}) MERGE (a)-[:"), _name(F.upper("relation"), "RELATES_TO"), F.lit(" {confidence: "), _text(F.coalesce("confidence", F.lit("EXTRACTED"))), F.lit("}]->(b);"))
    return nodes.select(node.alias("statement")).union(simple.select(edge))


def write(nodes: DataFrame, simple: DataFrame, path: str) -> None:
    statements(nodes, simple).write.mode("overwrite").text(path)
