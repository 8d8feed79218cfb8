"""Notes and reports in Markdown, as tables of (name, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import analyze


def _lines(by: DataFrame, key: str, order: list[str], line, name: str) -> DataFrame:
    packed = by.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("x"))
    return packed.select(key, F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias(name))


def community_articles(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """(name, text): an article for each community: its best-connected nodes, its links to
    others, its source files and how certain its edges are."""
    rich = analyze.rich_nodes(nodes, simple)
    top = analyze.community_articles(rich)
    key = _lines(top, "community", ["rank"], F.concat(F.lit("- **"), "label", F.lit("** ("), F.col("degree").cast("string"), F.lit(" connections)")), "key")
    links = analyze.cross_community_links(nodes, simple)
    w = Window.partitionBy("community").orderBy(F.desc("links"), "other")
    cross = _lines(links.withColumn("r", F.row_number().over(w)).filter("r <= 12"), "community", ["r"], F.concat(F.lit("- [[Community "), F.col("other").cast("string"), F.lit("]] ("), F.col("links").cast("string"), F.lit(" shared connections)")), "cross")
    files = nodes.filter("source_file <> ''").select("community", "source_file").distinct()
    wf = Window.partitionBy("community").orderBy("source_file")
    src = _lines(files.withColumn("r", F.row_number().over(wf)).filter("r <= 20"), "community", ["r"], F.concat(F.lit("- `"), "source_file", F.lit("`")), "src")
    conf = analyze.neighbors(simple).join(nodes.select("id", "community"), "id").groupBy("community", "confidence").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("community")
    audit = _lines(conf.withColumn("p", analyze.half_even_percent(F.col("n"), F.sum("n").over(total))), "community", ["confidence"], F.concat(F.lit("- "), "confidence", F.lit(": "), F.col("n").cast("string"), F.lit(" ("), F.col("p").cast("string"), F.lit("%)")), "audit")
    coh = analyze.cohesion(nodes, simple)
    x = coh
    for part in (key, cross, src, audit):
        x = x.join(part, "community", "left")
    text = F.concat(F.lit("# Community "), F.col("community").cast("string"), F.lit("\n\n> "), F.col("size").cast("string"), F.lit(" nodes · cohesion "), F.format_number("cohesion", 2), F.lit("\n\n## Key Concepts\n\n"), F.coalesce("key", F.lit("")), F.lit("\n\n## Relationships\n\n"), F.coalesce("cross", F.lit("- No strong cross-community connections detected")), F.lit("\n\n## Source Files\n\n"), F.coalesce("src", F.lit("")), F.lit("\n\n## Audit Trail\n\n"), F.coalesce("audit", F.lit("")), F.lit("\n"))
    return x.select(F.concat(F.lit("Community_"), F.col("community").cast("string"), F.lit(".md")).alias("name"), text.alias("text"))


def node_notes(nodes: DataFrame, simple: DataFrame, most: int = 200) -> DataFrame:
    """(name, text): a note for each node with front matter and its neighbours; names that clash
    after cleaning are numbered in the order of ids."""
    clean = F.substring(F.regexp_replace("label", r'[\\/*?:"<>|#^\[\]\n\r]', ""), 1, 200)
    base = nodes.withColumn("base", F.when(F.trim(clean) == "", "unnamed").otherwise(F.trim(clean)))
    w = Window.partitionBy(F.lower("base")).orderBy("id")
    named = base.withColumn("r", F.row_number().over(w)).withColumn("name", F.concat("base", F.when(F.col("r") > 1, F.concat(F.lit("_"), (F.col("r") - 1).cast("string"))).otherwise("")))
    nb = analyze.neighbors(simple).join(named.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other")
    wn = Window.partitionBy("id").orderBy("other_name", "other")
    links = _lines(nb.withColumn("k", F.row_number().over(wn)).filter(F.col("k") <= most), "id", ["k"], F.concat(F.lit("- [["), "other_name", F.lit("]] - `"), "relation", F.lit("` ["), "confidence", F.lit("]")), "links")
    x = named.join(links, "id", "left").join(analyze.dominant_confidence(simple).withColumnRenamed("confidence", "tag"), "id", "left")
    text = F.concat(F.lit("---\nsource_file: "), F.to_json(F.struct(F.coalesce("source_file", F.lit("")).alias("v"))), F.lit("\ncommunity: "), F.coalesce(F.col("community").cast("string"), F.lit("")), F.lit("\nconfidence: "), F.coalesce("tag", F.lit("")), F.lit("\n---\n\n# "), "label", F.lit("\n\n## Connections\n"), F.coalesce("links", F.lit("")), F.lit("\n"))
    return x.select(F.concat("name", F.lit(".md")).alias("name"), text.alias("text"))


def report(nodes: DataFrame, simple: DataFrame) -> str:
    """The analysis of a graph as one Markdown text; every part of it is bounded."""
    rich = analyze.rich_nodes(nodes, simple)
    mix = {r["confidence"]: r for r in analyze.confidence_mix(simple).collect()}
    n, e, c = nodes.count(), simple.count(), nodes.select("community").distinct().count()
    out = ["# Graph Report", "", "## Summary", f"- {n} nodes · {e} edges · {c} communities"]
    out.append("- Extraction: " + " · ".join(f"{mix[k]['percent'] if k in mix else 0}% {k}" for k in ("EXTRACTED", "INFERRED", "AMBIGUOUS")))
    out += ["", "## God Nodes"] + [f"{i}. `{r['label']}` - {r['degree']} edges" for i, r in enumerate(analyze.god_nodes(rich).collect(), 1)]
    out += ["", "## Surprising Connections"]
    for r in analyze.surprising_connections(analyze.surprise_scores(rich, simple)).collect():
        out += [f"- `{r['source']}` --{r['relation']}--> `{r['target']}`  [{r['confidence']}]", f"  {r['s_file']} → {r['d_file']}"]
    gaps = {r["kind"]: r["n"] for r in analyze.knowledge_gaps(rich).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    out += ["", "## Knowledge Gaps"] + [f"- {v} {k.replace('_', ' ')}s" for k, v in sorted(gaps.items())]
    out += ["", "## Suggested Questions"] + [f"- {r['question']}" for r in analyze.suggested_questions(rich, simple).collect()]
    return "\n".join(out) + "\n"


def canvas(nodes: DataFrame, simple: DataFrame, per_row: int = 5, edges: int = 200) -> tuple[DataFrame, DataFrame]:
    """(cards with places, the heaviest edges): communities side by side, nodes in rows."""
    w = Window.partitionBy("community").orderBy("id")
    i = F.col("i")
    cards = nodes.withColumn("i", F.row_number().over(w) - 1).select("id", "label", "community", (F.col("community") * 1600 + i % per_row * 300).alias("x"), (F.floor(i / per_row) * 120).alias("y"))
    return cards, simple.orderBy(F.desc("weight"), "lo", "hi").limit(edges).select("src", "dst", "relation")


def write_notes(notes: DataFrame, path: str) -> None:
    """Notes as Parquet rows; one file for each note would be too many small files at scale."""
    notes.write.mode("overwrite").parquet(path)
