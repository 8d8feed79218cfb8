"""Building graphs: canonical fields, validation, endpoints, collapse, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import id_key, lookup, stub_key, suffix
from ..schema import BUILD_FAMILIES, CONFIDENCES, DEFAULT_SCORES, FILE_TYPES

# Spellings of file types that are read as another.
FILE_TYPE_SYNONYMS = {
    "document": ["markdown", "text"],
    "code": ["tool", "library"],
    "concept": ["pattern", "principle", "constraint", "tech", "technology", "data-source", "data_source", "gotcha", "framework"],
}


def canonical_nodes(raw: DataFrame) -> DataFrame:
    """Nodes with ``source_file`` (or the older ``source``) and a known ``file_type``.

    A missing or empty type is ``concept``; an unknown one its synonym, else ``concept``.
    """
    old = F.col("source") if "source" in raw.columns else F.lit(None).cast("string")
    src = F.coalesce(F.col("source_file"), old) if "source_file" in raw.columns else old
    ft = F.col("file_type")
    kind = F.when(ft.isNull() | (ft == ""), "concept").when(ft.isin(FILE_TYPES), ft).otherwise(F.coalesce(lookup(ft, FILE_TYPE_SYNONYMS), F.lit("concept")))
    return raw.withColumns({"source_file": src, "file_type": kind}).drop("source")


def validation_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, row_id, detail) of missing fields, unknown values and dangling endpoints."""
    out = []
    for field in ("id", "label", "file_type", "source_file"):
        out.append(nodes.filter(F.col(field).isNull()).select(F.lit("node_missing").alias("kind"), F.coalesce("id", F.lit("?")).alias("row_id"), F.lit(field).alias("detail")))
    out.append(nodes.filter(F.col("file_type").isNotNull() & ~F.col("file_type").isin(FILE_TYPES)).select(F.lit("node_file_type"), F.coalesce("id", F.lit("?")), "file_type"))
    key = F.concat_ws("->", F.coalesce("src", F.lit("?")), F.coalesce("dst", F.lit("?")))
    for field in ("src", "dst", "relation", "confidence", "source_file"):
        out.append(edges.filter(F.col(field).isNull()).select(F.lit("edge_missing"), key, F.lit(field)))
    out.append(edges.filter(F.col("confidence").isNotNull() & ~F.col("confidence").isin(CONFIDENCES)).select(F.lit("edge_confidence"), key, "confidence"))
    ids = nodes.select(F.col("id").alias("_id")).filter("_id IS NOT NULL")
    for end in ("src", "dst"):
        out.append(edges.join(ids, F.col(end) == F.col("_id"), "left_anti").filter(F.col(end).isNotNull()).select(F.lit("edge_dangling"), key, F.lit(end)))
    first = out[0]
    for x in out[1:]:
        first = first.union(x)
    return first


def prune_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both endpoints among the nodes."""
    ids = nodes.select(F.col("id").alias("_id"))
    return edges.join(ids, F.col("src") == F.col("_id"), "left_semi").join(ids, F.col("dst") == F.col("_id"), "left_semi")


def repair_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose endpoints are node ids, or equal one after normalisation; others go.

    Several ids with one normal form are resolved to the smallest of them.
    """
    ids = nodes.select("id").distinct()
    normal = ids.groupBy(id_key(F.col("id")).alias("_key")).agg(F.min("id").alias("_norm"))
    out = edges
    for end in ("src", "dst"):
        exact = ids.withColumnRenamed("id", "_id")
        out = out.join(exact, F.col(end) == F.col("_id"), "left").join(normal, id_key(F.col(end)) == F.col("_key"), "left")
        out = out.withColumn(end, F.coalesce("_id", "_norm")).filter(F.col(end).isNotNull()).drop("_id", "_key", "_norm")
    return out


def drop_phantom_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Without INFERRED ``calls`` between files of different language families.

    Files without a suffix are not judged; an unknown family differs from a known one.
    """
    src = nodes.select(F.col("id").alias("_s"), suffix(F.coalesce("source_file", F.lit(""))).alias("_sx"))
    dst = nodes.select(F.col("id").alias("_d"), suffix(F.coalesce("source_file", F.lit(""))).alias("_dx"))
    same = lookup(F.col("_sx"), BUILD_FAMILIES).eqNullSafe(lookup(F.col("_dx"), BUILD_FAMILIES))
    phantom = (F.col("relation") == "calls") & (F.col("confidence") == "INFERRED") & (F.col("_sx") != "") & (F.col("_dx") != "") & ~same
    return edges.join(src, F.col("src") == F.col("_s"), "left").join(dst, F.col("dst") == F.col("_d"), "left").filter(~F.coalesce(phantom, F.lit(False))).drop("_s", "_sx", "_d", "_dx")


def collapse_edges(edges: DataFrame, directed: bool = False) -> DataFrame:
    """One edge for each pair of nodes, as if edges were written in the order of
    (src, dst, relation, ord), later ones over earlier ones.

    Undirected, a reverse edge (from the larger id to the smaller) is not written if the pair
    holds the same relation the other way round; attributes that the surviving
    edge lacks come from earlier writes.  One shuffle on the pair.
    """
    attrs = [c for c in edges.columns if c not in ("src", "dst", "ord")]
    e = edges.withColumns({"lo": F.least("src", "dst") if not directed else F.col("src"), "hi": F.greatest("src", "dst") if not directed else F.col("dst")})
    if not directed:
        pair = Window.partitionBy("lo", "hi")
        back = F.col("src") > F.col("dst")
        e = e.withColumns({"_back": back, "_rf": F.max(F.when(~back, F.col("relation"))).over(pair), "_rb": F.min(F.when(back, F.col("relation"))).over(pair)})
        e = e.filter(~F.coalesce(F.col("_back") & (F.col("relation") == F.col("_rf")) & (F.col("_rf") == F.col("_rb")), F.lit(False)))
        order = [F.col("_back"), F.col("relation"), F.col("ord")]
    else:
        order = [F.col("relation"), F.col("ord")]
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_v")))).getField("_v").alias(c)
    return e.groupBy("lo", "hi").agg(*(last(c) for c in ("src", "dst", *attrs)))


def upsert_nodes(old: DataFrame, new: DataFrame, keep: str = "last") -> DataFrame:
    """Nodes of both by id: ``last`` overlays attributes that are not null, ``first`` keeps the first row."""
    cols = [c for c in old.columns if c != "id"]
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    if keep == "first":
        return both.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct("_gen", "ord")).alias("_r")).select("id", "_r.*")
    return both.groupBy("id").agg(*(F.max(F.when(F.col(c).isNotNull(), F.struct("_gen", "ord", F.col(c).alias("_v")))).getField("_v").alias(c) if c != "ord" else F.min("ord").alias("ord") for c in cols))


def prune_sources(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without nodes and edges of the listed source files, and without dangling edges."""
    gone = sources.select(F.col("source_file").alias("_gone")).distinct()
    keep = lambda df: df.join(gone, F.col("source_file") == F.col("_gone"), "left_anti")
    left = keep(nodes)
    return left, prune_dangling(left, keep(edges))


def build_merge(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Existing and new fragments as one, the listed source files pruned from the result."""
    merged = upsert_nodes(nodes, new_nodes, "first")
    return prune_sources(merged, edges.unionByName(new_edges), sources)


def compose(current: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Union of two graphs' rows by key; values of ``other`` win where they are not null."""
    rest = [c for c in current.columns if c not in key]
    right = other.select(*(F.col(c).alias(f"_k_{c}") for c in key), *(F.col(c).alias(f"_o_{c}") for c in rest))
    on = [F.col(c) == F.col(f"_k_{c}") for c in key]
    return current.join(right, on, "full").select(*(F.coalesce(c, f"_k_{c}").alias(c) for c in key), *(F.coalesce(f"_o_{c}", c).alias(c) for c in rest))


def prefix_graph(nodes: DataFrame, repo: str) -> DataFrame:
    """Nodes with ids ``repo::id``, and the repo and local id beside."""
    return nodes.withColumns({"repo": F.lit(repo), "local_id": F.col("id"), "id": F.concat(F.lit(f"{repo}::"), F.col("id"))})


def global_add(existing: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New nodes for a registry: a node without source whose label the registry knows is skipped,
    and its edges with it."""
    known = existing.filter(F.coalesce("source_file", F.lit("")) == "").select(F.lower("label").alias("_l")).distinct()
    outer = F.coalesce("source_file", F.lit("")) == ""
    fresh = nodes.filter(~outer).unionByName(nodes.filter(outer).join(known, F.lower("label") == F.col("_l"), "left_anti"))
    return fresh, prune_dangling(fresh, edges)


def stub_rewire(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to stubs (nodes without source) led to the only type-like definition with the stub's key."""
    like = (F.col("file_type") == "code") & ~F.col("label").endswith(")") & ~F.col("label").contains(".") & (F.coalesce("source_file", F.lit("")) != "")
    unique = nodes.filter(like).groupBy(stub_key(F.col("label")).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_to")).filter("_n = 1 AND _key <> ''")
    stubs = nodes.filter(F.coalesce("source_file", F.lit("")) == "").select(F.col("id").alias("_stub"), stub_key(F.col("label")).alias("_key"))
    to = stubs.join(unique, "_key").select("_stub", "_to")
    out = edges
    for end in ("src", "dst"):
        out = out.join(to, F.col(end) == F.col("_stub"), "left").withColumn(end, F.coalesce("_to", end)).drop("_stub", "_to")
    return out.filter("src <> dst")


def disambiguate_ids(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids found in several source files become ``path + id`` keys; edges follow their own file."""
    many = nodes.groupBy("id").agg(F.countDistinct("source_file").alias("_n")).filter("_n > 1").select(F.col("id").alias("_many"))
    fresh = lambda path, name: id_key(F.concat_ws("_", path, name))
    n = nodes.join(many, F.col("id") == F.col("_many"), "left").withColumn("id", F.when(F.col("_many").isNotNull(), fresh(F.col("source_file"), F.col("id"))).otherwise(F.col("id"))).drop("_many")
    own = nodes.join(many, F.col("id") == F.col("_many"), "left_semi").select(F.col("id").alias("_id"), F.col("source_file").alias("_file")).distinct()
    e = edges
    for end in ("src", "dst"):
        e = e.join(own, (F.col(end) == F.col("_id")) & (F.col("source_file") == F.col("_file")), "left").withColumn(end, F.when(F.col("_id").isNotNull(), fresh(F.col("_file"), F.col("_id"))).otherwise(F.col(end))).drop("_id", "_file")
    return n, e


def score_defaults(edges: DataFrame) -> DataFrame:
    """Edges with a confidence score where there is none: by tag, 0.5 for unknown tags."""
    by_tag = None
    for tag, score in DEFAULT_SCORES.items():
        by_tag = F.when(F.col("confidence") == tag, score) if by_tag is None else by_tag.when(F.col("confidence") == tag, score)
    return edges.withColumn("confidence_score", F.coalesce("confidence_score", by_tag, F.lit(0.5)))


def edge_signature(directed: bool) -> list[Column]:
    if directed:
        return [F.col("src").alias("u"), F.col("dst").alias("v"), F.col("relation")]
    return [F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.col("relation")]


def diff_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, id, label) of nodes added and removed."""
    added = new.join(old.select("id"), "id", "left_anti").select(F.lit("added").alias("change"), "id", "label")
    return added.union(old.join(new.select("id"), "id", "left_anti").select(F.lit("removed"), "id", "label"))


def diff_edges(old: DataFrame, new: DataFrame, directed: bool = False) -> DataFrame:
    """(change, u, v, relation) of edges added and removed, ends in order if undirected."""
    a, b = (x.select(*edge_signature(directed)).distinct() for x in (old, new))
    on = ["u", "v", "relation"]
    return b.join(a, on, "left_anti").select(F.lit("added").alias("change"), *on).union(a.join(b, on, "left_anti").select(F.lit("removed"), *on))


def same_topology(old: DataFrame, new: DataFrame) -> bool:
    """Whether two edge tables are equal as multisets of (src, dst, relation, confidence)."""
    cols = ["src", "dst", "relation", "confidence"]
    a, b = old.select(*cols), new.select(*cols)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def attach_hyperedges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Hyperedges of both; a new one needs an id that is not there yet."""
    fresh = new.filter(F.col("id").isNotNull()).join(existing.select("id"), "id", "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def replace_files(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, evicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows, with those old ones that were neither extracted anew nor evicted."""
    gone = evicted.select("source_file").union(new_nodes.select("source_file")).distinct()
    left, _ = prune_sources(nodes, edges, gone)
    all_nodes = left.join(new_nodes.select("id"), "id", "left_anti").unionByName(new_nodes)
    kept = edges.join(gone, "source_file", "left_anti").select(*edges.columns)
    return all_nodes, prune_dangling(all_nodes, kept.unionByName(new_edges))


def sanitize_labels(nodes: DataFrame, limit: int = 256) -> DataFrame:
    """Labels without control characters, cut to ``limit`` characters."""
    return nodes.withColumn("label", F.substring(F.regexp_replace(F.coalesce("label", F.lit("")), r"[\x00-\x1F\x7F]", ""), 1, limit))


def fold_rationale(nodes: DataFrame, edges: DataFrame, min_chars: int = 80, min_words: int = 8) -> tuple[DataFrame, DataFrame]:
    """Sentence-like nodes that explain another become its ``rationale``; rationale and concept
    nodes go with their edges."""
    label = F.coalesce("label", F.lit(""))
    prose = ((F.length(label) >= min_chars) | (F.size(F.split(F.trim(label), r"\s+")) >= min_words)) & label.rlike("[.!?:]")
    typed = F.col("file_type").isin("rationale", "concept")
    told = edges.filter("relation = 'rationale_for'").select(F.col("src").alias("id"), F.col("dst").alias("_to"))
    folded = nodes.filter(prose).join(told, "id").groupBy("_to").agg(F.sort_array(F.collect_list("label")).alias("rationale"))
    said = nodes.filter(prose).join(told, "id", "left_semi").select("id").union(nodes.filter(typed).select("id")).distinct()
    left = nodes.join(said, "id", "left_anti")
    return left.join(folded, F.col("id") == F.col("_to"), "left").drop("_to"), prune_dangling(left, edges)


# Limits of one fragment.
FRAGMENT_LIMITS = {"nodes": 10_000, "edges": 100_000, "hyperedges": 10_000}
MAX_MEMBERS, MAX_ID = 256, 256


def fragment_errors(nodes: DataFrame, edges: DataFrame, hyper: DataFrame) -> DataFrame:
    """(kind, row_id) of what makes a fragment unsafe to merge: too many rows, ids that are empty, too
    long, hold other than ``A-Za-z0-9._:-`` or two dots, hyperedges with too few or too many members."""
    bad_id = lambda c: ~c.rlike("^[A-Za-z0-9._:-]+$") | c.contains("..") | (F.length(c) > MAX_ID)
    out = nodes.filter(F.col("id").isNull() | bad_id(F.col("id"))).select(F.lit("node_id").alias("kind"), F.substring(F.coalesce("id", F.lit("?")), 1, MAX_ID).alias("row_id"))
    for end in ("src", "dst"):
        out = out.union(edges.filter(F.col(end).isNull() | bad_id(F.col(end))).select(F.lit("edge_id"), F.substring(F.coalesce(end, F.lit("?")), 1, MAX_ID)))
    out = out.union(hyper.filter((F.coalesce(F.size("members"), F.lit(0)) < 2) | (F.size("members") > MAX_MEMBERS)).select(F.lit("hyperedge_members"), F.coalesce("id", F.lit("?"))))
    for name, df in (("nodes", nodes), ("edges", edges), ("hyperedges", hyper)):
        out = out.union(df.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FRAGMENT_LIMITS[name]).select(F.lit(f"too_many_{name}"), F.col("n").cast("string")))
    return out


def union_fragments(*parts: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several fragments in order; ``ord`` is made to follow the order of fragments."""
    shift = lambda df, i: df.withColumn("ord", F.lit(i).cast("long") * F.lit(1 << 40) + F.col("ord"))
    nodes, edges = shift(parts[0][0], 0), shift(parts[0][1], 0)
    for i, (n, e) in enumerate(parts[1:], 1):
        nodes, edges = nodes.unionByName(shift(n, i), allowMissingColumns=True), edges.unionByName(shift(e, i), allowMissingColumns=True)
    return nodes, edges


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price of model tokens, at prices for a million."""
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000
