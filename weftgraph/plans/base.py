"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..views import FILES, FK_EDGES, FK_NODES, PRS, Catalog, for_duckdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions that oracle texts may ask for.
CTES = {
    "nodes": FK_NODES,
    "edges": FK_EDGES,
    "files": FILES,
    "prs": PRS,
    # pairs of nodes with the edge that survives
    "simple": """
SELECT lo, hi, arg_max(src, o) AS src, arg_max(dst, o) AS dst, arg_max(relation, o) AS relation, arg_max(confidence, o) AS confidence,
  arg_max(confidence_score, o) FILTER (confidence_score IS NOT NULL) AS confidence_score, arg_max(context, o) FILTER (context IS NOT NULL) AS context,
  arg_max(weight, o) AS weight, arg_max(source_file, o) AS source_file
FROM (SELECT *, {'b': back, 'r': relation, 'o': ord} AS o FROM (
  SELECT *, src > dst AS back, least(src, dst) AS lo, greatest(src, dst) AS hi,
    max(CASE WHEN src <= dst THEN relation END) OVER (PARTITION BY least(src, dst), greatest(src, dst)) AS rf,
    min(CASE WHEN src > dst THEN relation END) OVER (PARTITION BY least(src, dst), greatest(src, dst)) AS rb FROM edges)
  WHERE NOT coalesce(back AND relation = rf AND rf = rb, false)) GROUP BY lo, hi""",
    "deg": "SELECT id, count(*) AS degree FROM (SELECT lo AS id FROM simple UNION ALL SELECT hi FROM simple) GROUP BY id",
    # nodes with degree and the boolean predicates
    "rich": r"""
SELECT n.*, coalesce(d.degree, 0) AS degree,
  label <> '' AND (label = regexp_extract(source_file, '[^/]*$') OR (starts_with(label, '.') AND ends_with(label, '()')) OR (ends_with(label, '()') AND coalesce(d.degree, 0) <= 1)) AS is_file,
  coalesce(source_file, '') = '' OR NOT contains(regexp_extract(source_file, '[^/]*$'), '.') AS is_concept,
  ends_with(lower(source_file), '.json') AND lower(trim(label)) IN ('start','end','name','id','type','properties','value','key','data','items','title','description','version','dependencies','devdependencies','peerdependencies','optionaldependencies','bundleddependencies','bundledependencies') AS is_json_key
FROM nodes n LEFT JOIN deg d USING (id)""",
    "nbr": "SELECT lo AS id, hi AS other, relation, confidence FROM simple UNION ALL SELECT hi, lo, relation, confidence FROM simple WHERE lo <> hi",
}


def oracle(body: str, *names: str) -> str:
    """DuckDB text of ``body`` with the CTEs it names, and those they need."""
    needs = {"simple": ["edges"], "deg": ["edges", "simple"], "rich": ["nodes", "edges", "simple", "deg"], "nbr": ["edges", "simple"]}
    wanted = [n for name in names for n in (*needs.get(name, []), name)]
    ordered = [n for n in CTES if n in wanted]
    if not ordered:
        return body
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    body = body.replace("RECURSIVE ", "", 1) if recursive else body
    head = ", ".join(f"{n} AS ({CTES[n] if n in ('simple', 'rich') else for_duckdb(CTES[n])})" for n in ordered)
    tail = body.strip()
    return f"WITH {recursive}{head}" + (f", {tail[5:]}" if tail.upper().startswith("WITH ") else f" {tail}")


def query(name: str, sql: str | None = None, *ctes: str):
    """Registers ``fn(catalog)`` under a name, with the SQL that must give the same rows."""

    def add(fn: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Catalog(spark, sf_dir))
        if sql is not None:
            SQL[name] = oracle(sql, *ctes)
        return fn

    return add
