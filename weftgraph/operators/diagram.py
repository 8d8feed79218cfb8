"""Diagrams of the graph: node kinds, edge scores, sections and the flow between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_SCORES

# Words that tell a node's kind, and words of the sections of an architecture.
KIND_TYPES = {"klass": ["class", "klass", "struct", "interface", "enum", "trait", "model"], "module": ["module", "file", "package", "namespace"], "api": ["endpoint", "route", "api", "handler", "controller"], "test": ["test", "spec"], "ui": ["component", "hook", "view", "page"]}
SECTIONS = {
    "extract-pipeline": "extract extractor tree sitter parser language python javascript typescript rust java go ast calls imports multilang",
    "build-graph": "build graph merge dedup node edge hyperedge json schema normalize confidence",
    "analysis-clustering": "cluster community leiden cohesion analyze god surprise question query path explain benchmark",
    "outputs-docs": "export html wiki obsidian canvas svg graphml report callflow mermaid tree documentation",
    "cli-skills": "main install uninstall skill agent claude codex opencode aider copilot kiro vscode hook command",
    "ingest-cache-update": "ingest fetch download url html markdown cache manifest watch update incremental transcribe video audio google",
    "serve-api": "serve api request response endpoint router handle upload search delete enrich",
    "security-global": "security safe ssrf xss path traversal global prefix prune repo clone",
    "tests-fixtures": "test tests fixture fixtures sample assert pytest mock",
}
MODULE_SUFFIXES = r"\.(py|ts|tsx|js|jsx|go|rs|java|kt|rb|php|cs|swift|vue|svelte)$"


def node_kind(node_type: Column | None = None) -> Column:
    """Kind of a node by its type, else by file type, source path and label."""
    raw = F.coalesce("label", "id", F.lit(""))
    label, src = F.lower(raw), F.lower(F.coalesce("source_file", F.lit("")))
    has = lambda words: label.rlike("|".join(words))
    rules: list[tuple[Column, str]] = [(F.lower(node_type).isin(v), k) for k, v in KIND_TYPES.items()] if node_type is not None else []
    rules += [
        (F.lower(F.coalesce("file_type", F.lit(""))).isin("rationale", "document"), "concept"),
        (src.contains("test") | label.startswith("test_") | src.contains("spec"), "test"),
        (has(["endpoint", "router", "api", "route"]), "api"),
        (has(["cli", "command", "click", "typer"]), "entry"),
        (has(["async", "await", "stream", "sse"]), "async"),
        (has(["component", "props", "hook", "store"]) | raw.rlike(r"^use[A-Z_\-]") | src.rlike(r"\.(tsx|jsx|vue|svelte)$"), "ui"),
        (raw.rlike(r"^\p{Lu}") & ~raw.endswith("()"), "klass"),
        (raw.rlike(MODULE_SUFFIXES), "module"),
    ]
    out = F.when(rules[0][0], rules[0][1])
    for cond, kind in rules[1:]:
        out = out.when(cond, kind)
    return out.otherwise("function")


def edge_score() -> Column:
    rel = F.col("relation")
    base = F.coalesce("confidence_score", F.lit(1.0)) + F.when(F.upper("confidence") == "EXTRACTED", 2.0).otherwise(0.0)
    return base + F.when(rel.isin("calls", "uses", "method"), 1.0).when(rel.isin("imports", "imports_from"), 0.6).when(rel == "contains", -0.2).when(rel == "rationale_for", -0.6).otherwise(0.0)


def is_shown() -> Column:
    conf = F.upper(F.coalesce("confidence", F.lit("EXTRACTED")))
    return (conf == "EXTRACTED") | ((conf == "INFERRED") & (F.coalesce("confidence_score", F.lit(1.0)) >= 0.85))


def preferred_edges(edges: DataFrame, structure: bool = False) -> DataFrame:
    """Edges for a readable diagram: the shown ones of the best relations, or all shown if there are none."""
    best = ["calls", "uses", "method", "imports", "imports_from"] + ["contains", "rationale_for", "conceptually_related_to"] * structure
    shown = edges.filter(is_shown())
    good = shown.filter(F.col("relation").isin(best))
    return shown if good.isEmpty() else good


def participation(edges: DataFrame) -> DataFrame:
    """(id, score): summed edge scores of each endpoint."""
    s = edges.select(F.explode(F.array("src", "dst")).alias("id"), edge_score().alias("s"))
    return s.groupBy("id").agg(F.round(F.sum("s"), 6).alias("score"))


def sections(nodes: DataFrame, labels: int = 80, least: int = 2) -> DataFrame:
    """(community, section, hits): the section whose words a community's labels and paths hold most
    often, the earlier one in a tie; ``other`` below ``least`` hits."""
    text = F.lower(F.concat_ws(" ", F.col("label"), F.col("source_file"), F.col("file_type")))
    top = nodes.select("community", "id", text.alias("t")).groupBy("community").agg(F.slice(F.array_sort(F.collect_list(F.struct("id", "t"))), 1, labels).alias("x")).select("community", F.array_join(F.transform("x", lambda v: v["t"]), " ").alias("t"))
    scores = [F.struct((-F.regexp_count("t", F.lit(r"(?<![a-z0-9])(?:" + "|".join(words.split()) + r")(?![a-z0-9])"))).alias("m"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(SECTIONS.items())]
    best = top.select("community", F.array_min(F.array(*scores)).alias("b"))
    return best.select("community", F.when(-F.col("b.m") >= least, F.col("b.name")).otherwise("other").alias("section"), (-F.col("b.m")).cast("long").alias("hits"))


def edge_classes(edges: DataFrame, node_section: DataFrame) -> DataFrame:
    """Edges with ``class``: intra, inter, or orphan if an end has no section."""
    s = lambda end, name: node_section.select(F.col("id").alias(end), F.col("section").alias(name))
    e = edges.join(s("src", "src_section"), "src", "left").join(s("dst", "dst_section"), "dst", "left")
    kind = F.when(F.col("src_section").isNull() | F.col("dst_section").isNull(), "orphan").when(F.col("src_section") == F.col("dst_section"), "intra").otherwise("inter")
    return e.withColumn("class", kind)


def section_flow(classed: DataFrame) -> DataFrame:
    """(src_section, dst_section, edges) of shown edges between sections."""
    return classed.filter((F.col("class") == "inter") & is_shown()).groupBy("src_section", "dst_section").agg(F.count(F.lit(1)).alias("edges"))


def with_scores(edges: DataFrame) -> DataFrame:
    tag = None
    for k, v in DEFAULT_SCORES.items():
        tag = F.when(F.col("confidence") == k, v) if tag is None else tag.when(F.col("confidence") == k, v)
    return edges.withColumn("confidence_score", F.coalesce("confidence_score", tag))


def diagram_nodes(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(id, place): at most ``most`` nodes for a diagram: those that call more than they are
    called, then ends of the best edges, then the rest by participation.

    Concepts only join while fewer than a third of the places (four at least) are taken.
    """
    usable = preferred_edges(edges)
    out = usable.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    into = usable.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    kinds = nodes.select("id", (node_kind() == "concept").alias("concept"))
    entry = kinds.join(out, "id").join(into, "id", "left").withColumn("i", F.coalesce("i", F.lit(0)))
    starts = entry.orderBy(F.desc(F.col("o") - F.col("i")), F.desc("o"), "id").limit(max(3, most // 3)).select("id", "concept", F.lit(0).alias("stage"), (F.col("i") - F.col("o")).cast("double").alias("k"), F.lit("").alias("t"))
    best = usable.orderBy(F.desc(edge_score()), "src", "dst").limit(most)
    ends = best.select(F.explode(F.array("src", "dst")).alias("id"), (-edge_score()).alias("k"), F.concat("src", F.lit("|"), "dst").alias("t")).join(kinds, "id").select("id", "concept", F.lit(1), "k", "t")
    rest = kinds.join(participation(usable), "id", "left").orderBy("concept", F.desc(F.coalesce("score", F.lit(0.0))), "id").limit(most).select("id", "concept", F.lit(2), F.when(F.col("concept"), 1e9).otherwise(-F.coalesce("score", F.lit(0.0))), F.col("id"))
    rows = sorted(starts.union(ends).union(rest).collect(), key=lambda r: (r[2], r[3], r[4], r[0]))  # a few times ``most`` rows
    picked: list[str] = []
    for r in rows:
        if len(picked) < most and r[0] not in picked and (r[2] == 2 or not r[1] or len(picked) < max(4, most // 3)):
            picked.append(r[0])
    return nodes.sparkSession.createDataFrame([(x, i) for i, x in enumerate(picked)], "id string, place int")


def flow_chain(order: list[str], flow: DataFrame, most: int = 7) -> list[str]:
    """Sections in reading order: from the least entered one along the strongest flow, each once."""
    rows = flow.collect()  # at most one row for each pair of sections
    into: dict[str, int] = {}
    for r in rows:
        into[r["dst_section"]] = into.get(r["dst_section"], 0) + r["edges"]
    if not order:
        return []
    chain = [min(order, key=lambda s: (into.get(s, 0), order.index(s)))]
    while len(chain) < min(most, len(order)):
        on = [(r["edges"], r["dst_section"]) for r in rows if r["src_section"] == chain[-1] and r["dst_section"] not in chain]
        chain.append(max(on)[1] if on else next(s for s in order if s not in chain))
    return chain


def call_table(nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(id, label, kind, callers, callees): short lists of labels on both sides of each node."""
    shown = edges.filter(is_shown()).select("src", "dst").distinct()
    label = nodes.select("id", "label")

    def side(own: str, other: str, name: str) -> DataFrame:
        named = shown.join(label.withColumnsRenamed({"id": other, "label": "l"}), other)
        return named.groupBy(F.col(own).alias("id")).agg(F.array_join(F.slice(F.array_sort(F.collect_set("l")), 1, most), ", ").alias(name))

    return nodes.select("id", "label", node_kind().alias("kind")).join(side("dst", "src", "callers"), "id", "left").join(side("src", "dst", "callees"), "id", "left").select("id", "label", "kind", F.coalesce("callers", F.lit("")).alias("callers"), F.coalesce("callees", F.lit("")).alias("callees"))


def symbol_tree(nodes: DataFrame, most: int = 200) -> DataFrame:
    """(source_file, place, name): symbols of each file, private names last, and one row for those left out."""
    own = nodes.filter(F.coalesce("source_file", F.lit("")) != "").filter(~((F.col("label") == F.regexp_extract("source_file", r"[^/]*$", 0)) & (F.col("file_type") == "code")))
    w = Window.partitionBy("source_file")
    x = own.withColumns({"place": F.row_number().over(w.orderBy(F.col("label").startswith("_"), F.lower("label"), "id")), "n": F.count(F.lit(1)).over(w)})
    left = x.filter((F.col("place") == most) & (F.col("n") > most)).select("source_file", (F.col("place") + 1).alias("place"), F.concat(F.lit("(+"), (F.col("n") - most).cast("string"), F.lit(" more)")).alias("name"))
    return x.filter(F.col("place") <= most).select("source_file", "place", F.col("label").alias("name")).union(left)
