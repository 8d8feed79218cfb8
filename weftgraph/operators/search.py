"""Keyword search over node labels."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import search_key

# Bonuses of the match tiers.
EXACT, PREFIX, SUBSTRING, SOURCE = 1000.0, 100.0, 1.0, 0.5
# Spellings of edge contexts, and words of a question that hint at one.
CONTEXT_ALIASES = {
    "parameter_type": "param params parameter parameters argument arguments arg args",
    "return_type": "return returns returned",
    "generic_arg": "generic generics template templates",
    "attribute": "annotation annotations decorator decorators",
    "call": "calls called invoke invocation",
    "field": "fields property properties member members",
    "import": "imports imported module modules",
    "export": "exports exported",
}
CONTEXT_HINTS = {
    "call": "call calls called invoke invokes invoked",
    "import": "import imports imported module modules",
    "field": "field fields member members property properties",
    "parameter_type": "parameter parameters param params argument arguments",
    "return_type": "return returns returned",
    "generic_arg": "generic generics template templates",
}


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def query_terms(question: str) -> list[str]:
    """Searchable terms: words of three letters or more, any others, and Chinese runs in pairs."""
    out: list[str] = []
    for raw in question.lower().split():
        if any("一" <= ch <= "鿿" for ch in raw):
            pairs = [raw[i : i + 2] for i in range(len(raw) - 1)] or [raw]
            found = pairs + [raw] * (len(raw) > 1 and raw not in pairs)
        else:
            found = re.findall(r"\w+", raw)
        out += [t for t in found if len(t) > 2 or not re.fullmatch("[a-z]*", t)]
    return out


def context_filters(question: str, explicit: list[str] | None = None) -> list[str]:
    """Explicit contexts by their usual names, else those that the question hints at."""
    alias = {word: name for name, words in CONTEXT_ALIASES.items() for word in words.split()}
    given = [plain(str(x)).strip() for x in explicit or ()]
    named = list(dict.fromkeys(alias.get(x, x) for x in given if x))
    if named:
        return named
    words = {plain(w) for w in re.split(r"[\s?,]+", question)}
    return [name for name, hints in CONTEXT_HINTS.items() if words & set(hints.split())]


def filter_context(edges: DataFrame, contexts: list[str]) -> DataFrame:
    return edges.filter(F.col("context").isin(contexts)) if contexts else edges


def _keys(nodes: DataFrame, unicode: bool) -> DataFrame:
    key = search_key(F.coalesce("label", F.lit("")), unicode)
    return nodes.withColumns({"_key": key}).withColumn("_bare", F.regexp_replace("_key", r"[()]+$", ""))


def idf(nodes: DataFrame, terms: list[str], unicode: bool = False) -> DataFrame:
    """(term, df, idf): nodes whose label holds the term; ln(1 + N / (1 + df)).

    The terms of one question are columns of a single pass.
    """
    k = _keys(nodes, unicode)
    one = k.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("_key").contains(t)).alias(f"t{i}") for i, t in enumerate(terms)))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df")) for i, t in enumerate(terms)))).alias("r")
    return one.select("n", rows).select("r.term", "r.df", F.round(F.ln(1 + F.col("n") / (1 + F.col("r.df"))), 10).alias("idf"))


def search(nodes: DataFrame, question: str, unicode: bool = False) -> DataFrame:
    """(id, label, score) of nodes that match a term of the question.

    Each term scores once, by its best tier, times its idf; a hit in the source path adds to it.
    """
    terms = list(dict.fromkeys(t for q in query_terms(question) for t in re.findall(r"\w+", plain(q))))
    if not terms:
        return nodes.limit(0).select("id", "label", F.lit(0.0).alias("score"))
    weight = {r["term"]: float(r["idf"]) for r in idf(nodes, terms, unicode).collect()}
    src = F.lower(F.coalesce("source_file", F.lit("")))
    score: Column = F.lit(0.0)
    for t in terms:
        k, b = F.col("_key"), F.col("_bare")
        tier = F.when((k == t) | (b == t), EXACT).when(k.startswith(t) | b.startswith(t), PREFIX).when(k.contains(t), SUBSTRING).otherwise(0.0)
        score = score + (tier + F.when(src.contains(t), SOURCE).otherwise(0.0)) * F.lit(weight[t])
    return _keys(nodes, unicode).select("id", "label", F.round(score, 6).alias("score")).filter("score > 0")


def seeds(scored: DataFrame, most: int = 3, gap: float = 0.2) -> DataFrame:
    """The best nodes (ties to the larger id), without those far below the first."""
    top = scored.orderBy(F.desc("score"), F.desc("id")).limit(most)
    best = top.agg(F.max("score").alias("best"))
    return top.join(F.broadcast(best)).filter(F.col("score") >= gap * F.col("best")).select("id", "label", "score")


def find_node(nodes: DataFrame, label: str, unicode: bool = False) -> DataFrame:
    """(id, tier): exact (0), prefix (1) and substring (2) matches."""
    term = " ".join(re.findall(r"\w+", plain(label)))
    k, b, i = F.col("_key"), F.col("_bare"), F.lower("id")
    tier = F.when((k == term) | (b == term) | (i == term), 0).when(k.startswith(term) | b.startswith(term) | i.startswith(term), 1).when(k.contains(term), 2)
    out = _keys(nodes, unicode).select("id", tier.alias("tier")).filter("tier IS NOT NULL")
    return out if term else out.limit(0)


def resolve_seed(nodes: DataFrame, text: str) -> DataFrame:
    """(id) of the one node meant: by id, else a unique label, source file or part of a label."""
    low = text.lower()
    label = F.lower(F.coalesce("label", F.lit("")))
    rules = [F.col("id") == text, label == low, F.lower(F.coalesce("source_file", F.lit(""))) == low, label.contains(low)]
    found = nodes.agg(*(x for i, r in enumerate(rules) for x in (F.count_if(r).alias(f"n{i}"), F.min(F.when(r, F.col("id"))).alias(f"i{i}"))))
    pick = F.coalesce(F.when(F.col("n0") > 0, F.col("i0")), *(F.when(F.col(f"n{i}") == 1, F.col(f"i{i}")) for i in (1, 2, 3)))
    return found.select(pick.alias("id")).filter("id IS NOT NULL")


def explain_node(edges: DataFrame, degrees: DataFrame, nodes: DataFrame, node: str, top: int = 20) -> DataFrame:
    """(direction, other, label, relation, degree) of a node's edges, the best-connected others first."""
    out = edges.filter(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "relation")
    back = edges.filter(F.col("dst") == node).select(F.lit("in"), "src", "relation")
    named = out.union(back).distinct().join(degrees.withColumnRenamed("id", "other"), "other").join(nodes.select(F.col("id").alias("other"), "label"), "other")
    return named.orderBy(F.desc("degree"), "other", "direction", "relation").limit(top).select("direction", "other", "label", "relation", "degree")


def node_neighbors(edges: DataFrame, node: str, relation: str = "") -> DataFrame:
    """(direction, other, relation): edges of a node whose relation holds a text."""
    e = edges.filter(F.contains(F.lower("relation"), F.lit(relation.lower())))
    out = e.filter(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "relation")
    return out.union(e.filter(F.col("dst") == node).select(F.lit("in"), "src", "relation")).distinct()


def render(reached: DataFrame, via: DataFrame, nodes: DataFrame, degrees: DataFrame, simple: DataFrame, tokens: int = 2000) -> str:
    """A subgraph as text within a budget of about 3 characters a token: nodes by degree, then edges.

    Only as many rows as can fit the budget come to the driver; the text ends with the number of
    nodes that were left out.
    """
    budget, least = tokens * 3, 20  # a line has more characters than this
    clean = lambda c: F.substring(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\x00-\x1F\x7F]", ""), 1, 256)
    own = reached.select("id").distinct()
    place = clean("source_location") if "source_location" in nodes.columns else F.lit("")
    named = own.join(nodes, "id").join(degrees, "id", "left")
    lines = named.orderBy(F.desc(F.coalesce("degree", F.lit(0))), "id").limit(budget // least).select(F.concat(F.lit("NODE "), clean("label"), F.lit(" [src="), clean("source_file"), F.lit(" loc="), place, F.lit(" community="), clean("community"), F.lit("]")).alias("line"))
    label = lambda end: nodes.select(F.col("id").alias(end), clean("label").alias(f"{end}_label"))
    pair = simple.select("lo", "hi", "relation", "confidence", "context")
    e = via.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")}).join(pair, ["lo", "hi"]).join(label("src"), "src").join(label("dst"), "dst")
    context = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit(" context="), clean("context"))).otherwise("")
    edges = e.orderBy("level", "src", "dst").limit(budget // least).select(F.concat(F.lit("EDGE "), "src_label", F.lit(" --"), clean("relation"), F.lit(" ["), clean("confidence"), context, F.lit("]--> "), "dst_label").alias("line"))
    total = own.count()
    text = "\n".join(r[0] for r in [*lines.collect(), *edges.collect()])
    if len(text) <= budget and total <= budget // least:
        return text
    cut = text.rfind("\n", 0, budget)
    text = text[: cut if cut > 0 else budget]
    shown = sum(x.startswith("NODE ") for x in text.split("\n"))
    return f"{text}\n... (truncated: {total - shown} more nodes are beyond the budget of about {tokens} tokens)"
