"""Entity resolution: nodes that mean the same become one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import damerau, dedup_key, jaro_winkler
from ..store import stored
from . import alike, overlap
from .traverse import FRONT, components

# Thresholds of the resolution.
MIN_ENTROPY, MERGE, SHORT, SHORT_MERGE, SHINGLE_OVERLAP = 2.5, 92.0, 12, 97.0, 0.7


def keyed(nodes: DataFrame, unicode: bool = False) -> DataFrame:
    return nodes.withColumn("key", dedup_key(F.coalesce("label", "id"), unicode))


def entropy(c: Column) -> Column:
    """Shannon bits per character."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars)
    part = lambda x: F.size(F.filter(chars, lambda y: y == x)) / n
    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, x: a - part(x) * F.log2(part(x)))
    return F.when(F.coalesce(c, F.lit("")) == "", 0.0).otherwise(total)


def winner_rank() -> list[Column]:
    """The survivor of a group: without a chunk suffix, with the shorter id, first."""
    return [F.col("id").rlike(r"_c\d+$").cast("int"), F.length("id"), F.col("id")]


def exact_duplicates(nodes: DataFrame) -> DataFrame:
    """(id, winner): nodes with one key in one source file, except the winners themselves."""
    k = keyed(nodes).filter("key <> ''").withColumn("src", F.coalesce("source_file", F.lit("")))
    best = k.groupBy("key", "src").agg(F.min(F.struct(*winner_rank())).getField("id").alias("winner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return k.join(best, ["key", "src"]).filter("id <> winner").select("id", "winner")


def shingles(key: Column, k: int = 3) -> Column:
    bare = F.replace(key, F.lit(" "), F.lit(""))
    return F.array_distinct(F.when(F.length(bare) < k, F.array(bare)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - (k - 1), F.lit(1))), lambda i: F.substr(bare, i, F.lit(k)))))


def similar_pairs(keys: DataFrame, least: float = SHINGLE_OVERLAP) -> DataFrame:
    """(a, b, overlap): distinct keys whose shingle sets have a Jaccard similarity of ``least`` or more; exact."""
    return overlap.similar_pairs(keys, least)


def is_variant(a: Column, b: Column) -> Column:
    """Short keys with one alphabetic stem and different suffixes, such as model numbers."""
    rx = r"^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$"
    short = F.greatest(F.length(a), F.length(b)) < SHORT
    stem = F.regexp_extract(a, rx, 1)
    return (a != b) & short & (stem != "") & (stem == F.regexp_extract(b, rx, 1)) & (F.regexp_extract(a, rx, 2) != F.regexp_extract(b, rx, 2))


def fuzzy_pairs(nodes: DataFrame, min_entropy: float = MIN_ENTROPY, merge: float = MERGE) -> DataFrame:
    """(a, b, score): keys similar enough to be merged."""
    k = keyed(nodes).filter("key <> ''")
    if min_entropy > 0:
        k = k.filter("label IS NOT NULL")  # keys of ids alone have no entropy
    # the few pairs that are found are weighed, not all keys
    p = stored(similar_pairs(k.select("key").distinct()).select("a", "b"), "similar")
    p = p.filter((entropy(F.col("a")) >= min_entropy) & (entropy(F.col("b")) >= min_entropy)).withColumn("jw", jaro_winkler("a", "b") * 100)
    short = F.greatest(F.length("a"), F.length("b")) < SHORT
    allowed = ~short | ((F.col("jw") >= SHORT_MERGE) & (F.length("a") == F.length("b")) & (damerau("a", "b") <= 1))
    return p.filter((F.col("jw") >= merge) & ~is_variant(F.col("a"), F.col("b")) & allowed).select("a", "b", F.round("jw", 4).alias("score"))


#: Added to the score of long keys that lie in one community.
BOOST, BOOST_LENGTH = 5.0, 12


def repo_guard(nodes: DataFrame) -> None:
    """Raises an error if nodes of several repositories are to be resolved as one."""
    repos = nodes.select("repo").filter(F.coalesce("repo", F.lit("")) != "").distinct().orderBy("repo").limit(3).collect()
    if len(repos) > 1:
        raise ValueError(f"nodes of several repositories: {', '.join(r[0] for r in repos)}")


def boosted(score: Column, a: Column, b: Column, same_community: Column) -> Column:
    """The score of two keys, with the bonus of long keys in one community."""
    return F.when(same_community & (F.least(F.length(a), F.length(b)) >= BOOST_LENGTH), score + BOOST).otherwise(score)


def ambiguous_pairs(nodes: DataFrame, low: float = 75.0, high: float = MERGE, remap: DataFrame | None = None, overlapping: float | None = None) -> DataFrame:
    """(a, b, score): keys that a judge should decide on, of all pairs, or only of those whose shingles overlap so much.

    Variants of a model number, short keys that must not be merged, and keys that are one after ``remap`` (id, winner) are left out.
    """
    k = keyed(nodes).filter("key <> ''")
    keys = k.select("key").distinct()
    near = alike.close_pairs(keys, low / 100) if overlapping is None else similar_pairs(keys, overlapping)
    p = stored(near.select("a", "b"), "similar").withColumn("jw", jaro_winkler("a", "b") * 100)
    short = F.greatest(F.length("a"), F.length("b")) < SHORT
    blocked = short & ~((F.col("jw") >= SHORT_MERGE) & (F.length("a") == F.length("b")) & (damerau("a", "b") <= 1))
    p = p.filter((F.col("jw") >= low) & (F.col("jw") < high) & ~is_variant(F.col("a"), F.col("b")) & ~blocked)
    if remap is not None:
        first = k.join(remap, "id", "left").groupBy("key").agg(F.min(F.coalesce("winner", "id")).alias("one"))
        for side in ("a", "b"):
            p = p.join(first.select(F.col("key").alias(side), F.col("one").alias(f"one_{side}")), side)
        p = p.filter("one_a <> one_b")
    return p.select("a", "b", F.round("jw", 4).alias("score"))


def resolve_entities(nodes: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """(id, winner) of the nodes that go: equal keys of a file, similar keys of any, and pairs of
    keys that a judge has ``decided`` to be one; linked transitively."""
    nodes = stored(nodes.select("id", "label", "source_file"), "entities")
    k = keyed(nodes).filter("key <> ''")
    first = k.groupBy("key").agg(F.min(F.struct(*winner_rank())).getField("id").alias("first"))
    links = exact_duplicates(nodes).select(F.col("id").alias("a"), F.col("winner").alias("b"))
    pairs = fuzzy_pairs(nodes).select("a", "b")
    pairs = pairs if decided is None else pairs.union(decided.select("a", "b"))
    pairs = stored(pairs, "decided")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    first = stored(first.join(ends, "key", "left_semi"), "first")
    for side in ("a", "b"):
        pairs = pairs.join(first.select(F.col("key").alias(side), F.col("first").alias(f"{side}_id")), side)
    both = links.union(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    comp = components(both)
    named = comp.select(F.col("node").alias("id"), "root")
    best = named.groupBy("root").agg(F.min(F.struct(*winner_rank())).getField("id").alias("winner"))
    return named.join(best, "root").filter("id <> winner").select("id", "winner")


def rewrite_edges(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges between survivors; loops made by a merge go."""
    e = edges
    remap = stored(remap.select("id", "winner"), "remap")
    if remap.count() <= FRONT:  # else both ends are dealt out by id
        remap = F.broadcast(remap)
    for end in ("src", "dst"):
        e = e.join(remap.select(F.col("id").alias("_old"), F.col("winner").alias("_new")), F.col(end) == F.col("_old"), "left").withColumn(end, F.coalesce("_new", end)).drop("_old", "_new")
    return e.filter("src <> dst")


def dedup_by_label(nodes: DataFrame) -> DataFrame:
    """(id, winner) of nodes with one key, whatever their files."""
    k = keyed(nodes).filter("key <> ''")
    best = k.groupBy("key").agg(F.min(F.struct(*winner_rank())).getField("id").alias("winner"))
    return k.join(best, "key").filter("id <> winner").select("id", "winner")
