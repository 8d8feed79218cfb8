"""Small sources: workspace pointers, answers that become corpus, prompts for transcription."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def workspace_pointers(files: DataFrame) -> DataFrame:
    """(path, file_id, url, resource_key, account) of pointer files (path, content); the id is a field or part of the URL."""
    g = lambda k: F.when(F.get_json_object("content", f"$.{k}") != "", F.get_json_object("content", f"$.{k}"))
    url = g("url")
    query = lambda k: F.when(F.regexp_extract(url, rf"[?&]{k}=([^&#]+)", 1) != "", F.regexp_extract(url, rf"[?&]{k}=([^&#]+)", 1))
    from_path = F.regexp_extract(url, r"/(?:document|spreadsheets|presentation|file)/d/([^/?#]+)", 1)
    after = F.regexp_extract(F.coalesce(g("resource_id"), F.lit("")), r":(.+)$", 1)
    file_id = F.coalesce(g("doc_id"), g("file_id"), g("fileId"), g("id"), query("id"), F.when(from_path != "", from_path), F.when(after != "", after))
    return files.select("path", file_id.alias("file_id"), url.alias("url"), F.coalesce(g("resource_key"), g("resourceKey"), query("resourcekey")).alias("resource_key"), g("email").alias("account")).filter("file_id IS NOT NULL")


def save_answers(answers: DataFrame, path: str) -> None:
    """Appends (question, answer, asked_at, nodes) as Markdown rows that the next scan reads."""
    slug = F.regexp_replace(F.substring(F.regexp_replace(F.lower("question"), r"[^\w]", "_"), 1, 50), "^_+|_+$", "")
    name = F.concat(F.lit("query_"), F.date_format("asked_at", "yyyyMMdd_HHmmss"), F.lit("_"), slug, F.lit(".md"))
    text = F.concat(F.lit('---\ntype: "query"\nquestion: '), F.to_json(F.struct(F.col("question").alias("q"))), F.lit("\n---\n\n# Q: "), "question", F.lit("\n\n## Answer\n\n"), "answer", F.lit("\n\n## Source Nodes\n\n"), F.array_join(F.transform("nodes", lambda n: F.concat(F.lit("- "), n)), "\n"))
    answers.select(name.alias("path"), text.alias("content")).write.mode("append").parquet(path)


def transcription_prompt(gods: DataFrame, most: int = 5) -> str:
    """A hint on the topics of a corpus, from its most connected entities."""
    labels = [r["label"] for r in gods.orderBy(F.desc("degree"), "id").limit(most).collect() if r["label"]]
    return f"Technical discussion about {', '.join(labels)}. Use proper punctuation and paragraph breaks." if labels else "Use proper punctuation and paragraph breaks."
