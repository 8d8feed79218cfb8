"""Degrees, hubs, surprises, gaps, questions and statistics of a graph.

``simple`` is an edge table with one row for each pair (``collapse_edges``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import base_name, half_even_percent, lookup, suffix
from ..schema import CODE_SUFFIXES, IMAGE_SUFFIXES, JSON_NOISE_LABELS, PAPER_SUFFIXES, SCORE_FAMILIES, STRUCTURAL_RELATIONS
from . import traverse


def degree(simple: DataFrame) -> DataFrame:
    """(id, degree) over distinct pairs; a self-loop counts twice."""
    ends = simple.select(F.explode(F.array("lo", "hi")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def neighbors(simple: DataFrame) -> DataFrame:
    """(id, other, relation, confidence) both ways; self-loops once."""
    there = simple.select(F.col("lo").alias("id"), F.col("hi").alias("other"), "relation", "confidence")
    back = simple.filter("lo <> hi").select(F.col("hi").alias("id"), F.col("lo").alias("other"), "relation", "confidence")
    return there.union(back)


def is_file() -> Column:
    label = F.col("label")
    method = label.startswith(".") & label.endswith("()")
    loose = label.endswith("()") & (F.col("degree") <= 1)
    return (label != "") & ((label == base_name(F.col("source_file"))) | method | loose)


def is_concept() -> Column:
    src = F.coalesce("source_file", F.lit(""))
    return (src == "") | ~base_name(src).contains(".")


def is_json_key() -> Column:
    return F.lower("source_file").endswith(".json") & F.lower(F.trim("label")).isin(JSON_NOISE_LABELS)


def rich_nodes(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """Nodes with degree (0 for isolates), is_file, is_concept and is_json_key."""
    n = nodes.join(degree(simple), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return n.withColumns({"is_file": is_file(), "is_concept": is_concept(), "is_json_key": is_json_key()})


def god_nodes(rich: DataFrame, top: int = 10) -> DataFrame:
    """The most connected entities; ties go to the smaller id."""
    return rich.filter("NOT is_file AND NOT is_concept AND NOT is_json_key").orderBy(F.desc("degree"), "id").limit(top).select("id", "label", "degree")


def file_category(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(CODE_SUFFIXES), "code").when(s.isin(PAPER_SUFFIXES), "paper").when(s.isin(IMAGE_SUFFIXES), "image").otherwise("doc")


def surprise_scores(rich: DataFrame, simple: DataFrame) -> DataFrame:
    """Score of each pair that links real entities of different files by a non-structural relation."""
    side = lambda p: rich.select(F.col("id").alias(f"{p}_id"), F.col("label").alias(f"{p}_label"), F.col("source_file").alias(f"{p}_file"), F.col("community").alias(f"{p}_com"), F.col("degree").alias(f"{p}_deg"), (F.col("is_file") | F.col("is_concept")).alias(f"{p}_skip"))
    e = simple.filter(~F.col("relation").isin(STRUCTURAL_RELATIONS))
    e = e.join(side("s"), F.col("src") == F.col("s_id")).join(side("d"), F.col("dst") == F.col("d_id"))
    e = e.filter("NOT s_skip AND NOT d_skip AND s_file <> d_file")
    cs, cd = file_category(F.col("s_file")), file_category(F.col("d_file"))
    fs, fd = lookup(suffix(F.col("s_file")), SCORE_FAMILIES), lookup(suffix(F.col("d_file")), SCORE_FAMILIES)
    foreign = F.coalesce(fs != fd, F.lit(False))
    code_doc = ((cs == "code") & (cd == "doc")) | ((cs == "doc") & (cd == "code"))
    mute = (F.col("confidence") == "INFERRED") & F.col("relation").isin("calls", "uses") & (foreign | code_doc)
    point = lambda cond, n: F.when(cond & ~F.col("_mute"), n).otherwise(0)
    e = e.withColumns({"_mute": mute, "_cs": cs, "_cd": cd})
    base = F.when(F.col("_mute"), 0).when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    top_dir = lambda c: F.regexp_extract(c, "^[^/]*", 0)
    score = base + point(F.col("_cs") != F.col("_cd"), 2) + point(top_dir("s_file") != top_dir("d_file"), 2) + point(F.coalesce(F.col("s_com") != F.col("d_com"), F.lit(False)), 1)
    score = F.when(F.col("relation") == "semantically_similar_to", F.floor(score * 1.5)).otherwise(score)
    score = score + F.when((F.least("s_deg", "d_deg") <= 2) & (F.greatest("s_deg", "d_deg") >= 5), 1).otherwise(0)
    return e.select("src", "dst", F.col("s_label").alias("source"), F.col("d_label").alias("target"), "s_file", "d_file", "relation", "confidence", score.cast("long").alias("score"))


def surprising_connections(scored: DataFrame, top: int = 5) -> DataFrame:
    return scored.orderBy(F.desc("score"), "src", "dst").limit(top)


def community_bridges(rich: DataFrame, simple: DataFrame, top: int = 5) -> DataFrame:
    """One edge for each pair of communities, the least certain first."""
    side = lambda p: rich.select(F.col("id").alias(f"{p}_id"), F.col("label").alias(f"{p}_label"), F.col("community").alias(f"{p}_com"), F.col("is_file").alias(f"{p}_skip"))
    e = simple.filter(~F.col("relation").isin(STRUCTURAL_RELATIONS)).join(side("s"), F.col("src") == F.col("s_id")).join(side("d"), F.col("dst") == F.col("d_id"))
    e = e.filter("s_com <> d_com AND NOT s_skip AND NOT d_skip")
    rank = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).when(F.col("confidence") == "EXTRACTED", 2).otherwise(3)
    # the least row of each pair, with map-side combination
    best = e.groupBy(F.least("s_com", "d_com").alias("com_a"), F.greatest("s_com", "d_com").alias("com_b")).agg(F.min(F.struct(rank.alias("rank"), "src", "dst", "s_label", "d_label", "relation", "confidence")).alias("b"))
    return best.select("com_a", "com_b", "b.*").orderBy("rank", "src", "dst").limit(top).select("com_a", "com_b", "src", "dst", F.col("s_label").alias("source"), F.col("d_label").alias("target"), "relation", "confidence")


def cohesion(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """(community, size, intra, cohesion): edges within over possible ones; 1 for one node."""
    c = nodes.select("id", "community")
    inside = simple.join(c.select(F.col("id").alias("lo"), F.col("community").alias("a")), "lo").join(c.select(F.col("id").alias("hi"), F.col("community").alias("b")), "hi").filter("a = b").groupBy(F.col("a").alias("community")).agg(F.count(F.lit(1)).alias("intra"))
    size = c.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    value = F.when(F.col("size") <= 1, 1.0).otherwise(F.coalesce("intra", F.lit(0)) / (F.col("size") * (F.col("size") - 1) / 2.0))
    return size.join(inside, "community", "left").select("community", "size", F.coalesce("intra", F.lit(0)).alias("intra"), F.round(value, 8).alias("cohesion"))


def confidence_mix(edges: DataFrame) -> DataFrame:
    """(confidence, edges, percent, mean_score): shares rounded half to even; INFERRED scores default to 0.5."""
    tag = F.coalesce("confidence", F.lit("EXTRACTED"))
    by = edges.groupBy(tag.alias("confidence")).agg(F.count(F.lit(1)).alias("edges"), F.avg(F.when(tag == "INFERRED", F.coalesce("confidence_score", F.lit(0.5)))).alias("m"))
    total = by.agg(F.sum("edges").alias("all_edges"))
    return by.join(F.broadcast(total)).select("confidence", "edges", half_even_percent(F.col("edges"), F.col("all_edges")).alias("percent"), F.round("m", 6).alias("mean_score"))


def knowledge_gaps(rich: DataFrame) -> DataFrame:
    """(kind, key): weakly connected entities, and communities with one or two real nodes."""
    weak = rich.filter("degree <= 1 AND NOT is_file AND NOT is_concept AND file_type <> 'rationale'").select(F.lit("weak_node").alias("kind"), F.col("id").alias("key"))
    thin = rich.filter("NOT is_file").groupBy("community").agg(F.count(F.lit(1)).alias("n")).filter("n < 3").select(F.lit("thin_community"), F.col("community").cast("string"))
    return weak.union(thin)


def bridging_edges(simple: DataFrame, top: int = 5, between: DataFrame | None = None) -> DataFrame:
    """Edges of ``simple`` with the highest betweenness (lo, hi, score): surprises of a graph without communities."""
    if between is None:
        near = neighbors(simple)
        between = traverse.edge_betweenness(near, traverse.pivots(near))
    return simple.join(between, ["lo", "hi"]).orderBy(F.desc("score"), "lo", "hi").limit(top)


def suggested_questions(rich: DataFrame, simple: DataFrame, top: int = 7, between: DataFrame | None = None) -> DataFrame:
    """(family, question) from five families in fixed order: unclear edges, bridges between communities, inferred edges of
    hubs, weak nodes, loose communities.  ``between`` has the scores (id, score) of bridges; betweenness, if it isn't given."""
    if between is None:
        near = neighbors(simple)
        between = traverse.betweenness(near, traverse.pivots(near))
    label = rich.select("id", "label")
    named = simple.filter("confidence = 'AMBIGUOUS'").orderBy("src", "dst").limit(top).join(label.withColumnsRenamed({"id": "src", "label": "ul"}), "src").join(label.withColumnsRenamed({"id": "dst", "label": "vl"}), "dst")
    q1 = named.select(F.lit(1).alias("family"), F.concat("src", F.lit("|"), "dst").alias("o"), F.concat(F.lit("What is the exact relationship between `"), "ul", F.lit("` and `"), "vl", F.lit("`?")).alias("question"))
    bridge = rich.filter("NOT is_file AND NOT is_concept").join(between.filter("score > 0").select("id", "score"), "id").orderBy(F.desc("score"), "id").limit(3).select("id", "label", "community", "score")
    far = neighbors(simple).select("id", "other").join(F.broadcast(bridge), "id").join(rich.select(F.col("id").alias("other"), F.col("community").alias("oc")), "other").filter("NOT oc <=> community")
    there = F.array_join(F.transform(F.array_sort(F.collect_set("oc")), lambda x: F.concat(F.lit("`Community "), x.cast("string"), F.lit("`"))), ", ")
    q5 = far.groupBy("id", "label", "community", "score").agg(there.alias("there")).select(F.lit(2), F.concat(F.lpad((F.lit(1e12) - F.col("score")).cast("decimal(20,6)").cast("string"), 24, "0"), "id"), F.concat(F.lit("Why does `"), "label", F.lit("` connect `Community "), F.col("community").cast("string"), F.lit("` to "), "there", F.lit("?")))
    hubs = rich.filter("NOT is_file").orderBy(F.desc("degree"), "id").limit(5).select("id", "label", "degree")
    inferred = neighbors(simple).filter("confidence = 'INFERRED'").join(F.broadcast(hubs), "id").groupBy("id", "label", "degree").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    q2 = inferred.select(F.lit(3), F.concat(F.lpad((F.lit(10**9) - F.col("degree")).cast("string"), 12, "0"), "id"), F.concat(F.lit("Are the "), F.col("n").cast("string"), F.lit(" inferred relationships involving `"), "label", F.lit("` actually correct?")))
    weak = rich.filter("degree <= 1 AND NOT is_file AND NOT is_concept").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "label")).alias("f")).filter("n > 0")
    q3 = weak.select(F.lit(4), F.lit(""), F.concat(F.lit("What connects `"), "f.label", F.lit("` and "), (F.col("n") - 1).cast("string"), F.lit(" more to the rest of the system?")))
    loose = cohesion(rich, simple).filter("cohesion < 0.15 AND size >= 5")
    q4 = loose.select(F.lit(5), F.lpad(F.col("community").cast("string"), 12, "0"), F.concat(F.lit("Should `Community "), F.col("community").cast("string"), F.lit("` be split into smaller, more focused modules?")))
    return q1.union(q5).union(q2).union(q3).union(q4).orderBy("family", "o").limit(top).select("family", "question")


def community_meta_edges(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """(com_a, com_b, edges) of pairs of different communities."""
    c = nodes.select("id", "community")
    e = simple.join(c.select(F.col("id").alias("lo"), F.col("community").alias("a")), "lo").join(c.select(F.col("id").alias("hi"), F.col("community").alias("b")), "hi").filter("a <> b")
    return e.groupBy(F.least("a", "b").alias("com_a"), F.greatest("a", "b").alias("com_b")).agg(F.count(F.lit(1)).alias("edges"))


def cross_community_links(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """(community, other, links): neighbour edges from a community's nodes into another."""
    meta = community_meta_edges(nodes, simple)
    there = meta.select(F.col("com_a").alias("community"), F.col("com_b").alias("other"), F.col("edges").alias("links"))
    return there.union(meta.select("com_b", "com_a", "edges"))


def community_reach(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """(id, reach): number of other communities among a node's neighbours."""
    c = nodes.select("id", "community")
    n = neighbors(simple).select("id", "other").join(c, "id").join(c.select(F.col("id").alias("other"), F.col("community").alias("oc")), "other")
    return n.filter("oc <> community").groupBy("id").agg(F.countDistinct("oc").alias("reach"))


def dominant_confidence(simple: DataFrame) -> DataFrame:
    """(id, confidence): the most frequent tag of a node's edges, ties to the smaller name."""
    by = neighbors(simple).groupBy("id", "confidence").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("m"), "confidence")).getField("confidence").alias("confidence"))


def community_articles(rich: DataFrame, top: int = 25) -> DataFrame:
    """(community, rank, id, label, degree): the best-connected nodes of each community."""
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "id")
    return rich.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("community", "rank", "id", "label", "degree")


def community_ids(nodes: DataFrame) -> DataFrame:
    """(community, size, rank): communities renumbered by size, then by their sorted members."""
    by = nodes.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    # members are disjoint, so the first of the sorted members decides every tie
    order = by.orderBy(F.desc("size"), "first").select("community", "size", "first")
    return order.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "first")) - 1).select("community", "size", "rank")


def community_overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_community, new_community, overlap) of two assignments of nodes."""
    a = old.select("id", F.col("community").alias("old_community"))
    return a.join(new.select("id", F.col("community").alias("new_community")), "id").groupBy("old_community", "new_community").agg(F.count(F.lit(1)).alias("overlap"))


def hub_nodes(deg: DataFrame, percentile: float = 99.0) -> DataFrame:
    """(id, degree) above the given percentile of degrees (the value at floor(n p / 100) - 1)."""
    n = deg.count()
    if not n:
        return deg
    at = max(0, int(n * percentile / 100) - 1)
    # the degree at a position, from the counts of each degree
    hist = deg.groupBy("degree").agg(F.count(F.lit(1)).alias("c"))
    upto = hist.withColumn("upto", F.sum("c").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)))
    cut = upto.filter(F.col("upto") > at).agg(F.min("degree").alias("cut"))
    return deg.join(F.broadcast(cut)).filter("degree > cut").select("id", "degree")


def hub_reattach(hubs: DataFrame, simple: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, community): each hub goes where most of its neighbours that aren't hubs are; ties to the lower number."""
    rest = nodes.join(hubs.select("id"), "id", "left_anti").select(F.col("id").alias("other"), "community")
    votes = neighbors(simple).join(hubs.select("id"), "id", "left_semi").join(rest, "other").groupBy("id", "community").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("m"), "community")).getField("community").alias("community"))


def hyperedge_rollup(hyper: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, communities): hyperedges whose members lie in two communities or more."""
    m = hyper.select("id", F.explode("members").alias("member")).join(nodes.select(F.col("id").alias("member"), "community"), "member")
    by = m.groupBy("id").agg(F.array_sort(F.collect_set("community")).alias("c")).filter(F.size("c") >= 2)
    return by.select("id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("communities"))


def community_label_inputs(rich: DataFrame, communities: int = 200, labels: int = 12) -> DataFrame:
    """(community, size, labels): for the largest communities, up to ``labels`` distinct labels, the
    best-connected first; what a naming model is shown."""
    size = rich.groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community").limit(communities)
    one = rich.groupBy("community", F.lower("label").alias("l")).agg(F.max_by("label", F.struct("degree", "id")).alias("label"), F.max("degree").alias("degree"))
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "l")
    top = one.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= labels)
    lists = top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]), ", ").alias("labels"))
    return size.join(lists, "community").select("community", "size", "labels")


def token_reduction(words: DataFrame, query_chars: DataFrame) -> DataFrame:
    """(corpus_tokens, query_tokens, ratio): words * 100 div 75 over the floored mean of chars div 4."""
    c = words.agg((F.sum("words") * 100 / 75).cast("long").alias("corpus_tokens"))
    q = query_chars.agg(F.floor(F.avg(F.greatest(F.lit(1), F.floor(F.col("chars") / 4)))).cast("long").alias("query_tokens"))
    return c.join(F.broadcast(q)).withColumn("ratio", F.round(F.col("corpus_tokens") / F.col("query_tokens"), 1))
