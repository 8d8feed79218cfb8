"""Queries of corpus scans, resolutions between files, and the order of pull requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, prs, resolve
from ..views import for_duckdb
from .base import query
from .more_queries import _HITS, TODAY

# files of which some lie in folders that a scan leaves out
NOISY = "SELECT CASE length(content) % 6 WHEN 0 THEN 'node_modules/' || path WHEN 1 THEN 'app/my_venv/' || path WHEN 2 THEN '.tool/worktrees/' || path WHEN 3 THEN 'worktrees/' || path WHEN 4 THEN 'src/build/' || path ELSE path END AS path, content FROM {files}"
_NOISE = r"(regexp_matches(path, '(^|/)(node_modules|build)/') OR contains(path, '_venv/') OR regexp_matches(path, '(^|/)\.[^/]*/worktrees/'))"
RULES = ["# generated", "*.png", "/web/", "src1", "!*.txt", "docs/src2/d1*  # a note", ""]
_IGNORED = r"""(SELECT path, bool_or(CASE WHEN starts_with(p, 'docs/src2/d1') THEN true WHEN regexp_matches(p, '\.txt(/|$)') THEN false WHEN regexp_matches(p, '(^|/)src1(/|$)') THEN true WHEN p = 'web' THEN true WHEN regexp_matches(p, '\.png(/|$)') THEN true ELSE false END) AS ignored
 FROM (SELECT path, unnest(list_transform(generate_series(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS p FROM {view}) GROUP BY path)"""


def _noisy(c):
    return c.spark.sql(NOISY, files=c.files)


@query("noise_files", f"SELECT path, {_NOISE} AS noise FROM ({NOISY.replace('{files}', 'files')})", "files")
def _(c):
    return _noisy(c).select("path", detect.in_noise(F.col("path")).alias("noise"))


@query("ignored_files", f"SELECT path, ignored FROM {_IGNORED.replace('{view}', 'files')}", "files")
def _(c):
    return detect.ignored(c.files, detect.parse_ignore(RULES))


@query("allowed_files", r"SELECT path, regexp_matches(path, '(^|/)src3(/|$)') OR regexp_matches(path, '^web/p1[^/]*\.html$') AS allowed FROM files", "files")
def _(c):
    return detect.allowed(c.files, detect.parse_ignore(["src3", "/web/p1*.html"]))


_TRIMMED = "trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_SCANNED = rf"""v AS ({NOISY.replace('{files}', 'files')}), x AS (SELECT path, lower(regexp_extract(path, '[^/]+\.([^./]+)$', 1)) AS s, substr(content, 1, 3000) AS h, CASE WHEN coalesce({_TRIMMED}, '') = '' THEN 0 ELSE len(regexp_split_to_array({_TRIMMED}, '\s+')) END AS words FROM v),
k AS (SELECT path, words, CASE WHEN s = 'py' THEN 'code' WHEN s = 'pdf' THEN 'paper' WHEN s = 'png' THEN 'image' WHEN s IN ('md', 'txt', 'html') THEN CASE WHEN {_HITS} >= 3 THEN 'paper' ELSE 'document' END WHEN s = 'mp4' THEN 'video' END AS kind FROM x),
f AS (SELECT kind, words FROM k JOIN {_IGNORED.replace('{view}', 'v')} USING (path) WHERE kind IS NOT NULL AND NOT ignored AND NOT {_NOISE})"""


def _scan(c):
    return detect.scan(_noisy(c), detect.parse_ignore(RULES))


@query("corpus_scan", f"WITH {_SCANNED} SELECT kind, count(*) AS files, CAST(sum(words) AS BIGINT) AS words FROM f GROUP BY kind", "files")
def _(c):
    return _scan(c).groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("words").alias("words"))


@query("corpus_verdict", f"WITH {_SCANNED} SELECT count(*) AS files, CAST(coalesce(sum(words), 0) AS BIGINT) AS words, coalesce(sum(words), 0) >= 50000 AS needs_graph, count(*) >= 200 OR coalesce(sum(words), 0) >= 500000 AS large FROM f", "files")
def _(c):
    return detect.verdict(_scan(c))


# ---- resolutions

TYPES = "SELECT 'nation:' || n_nationkey AS id, 'Nation' || n_nationkey || CASE WHEN n_nationkey % 6 = 5 THEN '.java' ELSE '' END AS label, 'geo/Nation' || n_nationkey || '.java' AS source_file FROM {nation}"
JAVA = "SELECT CASE WHEN o_orderkey % 50 = 7 THEN 'nation:7' ELSE 'customer:' || o_custkey END AS file, CASE o_orderkey % 4 WHEN 0 THEN 'a.b.Nation' || (o_custkey % 30) WHEN 1 THEN 'static a.b.Nation' || (o_custkey % 30) || '.make' WHEN 2 THEN 'a.Nation1.*' ELSE 'java.util.List' END AS name, o_orderkey AS line FROM {orders}"


@query("java_imports", rf"""
WITH t AS (SELECT label, id AS dst FROM ({for_duckdb(TYPES)}) WHERE NOT ends_with(label, '.java')), i AS (SELECT file AS src, line, regexp_extract(name, '(Nation[0-9]+)(\.make)?$', 1) AS label FROM ({for_duckdb(JAVA)}))
SELECT src, dst, 'imports' AS relation, 'EXTRACTED' AS confidence, CAST(1.0 AS DOUBLE) AS confidence_score, 'L' || min(line) AS source_location FROM i JOIN t USING (label) WHERE src <> dst GROUP BY src, dst""")
def _(c):
    return resolve.java_imports(c.sql(TYPES), c.sql(JAVA))


SCRIPTS = "SELECT 'sh/d' || (s_suppkey % 10) || '/s' || s_suppkey || '.sh' AS path, 'file:' || s_suppkey AS id FROM {supplier}"
SOURCES = "SELECT 'sh/d' || (s_suppkey % 10) || '/s' || s_suppkey || '.sh' AS path, '../d' || ((s_suppkey + 1) % 10) || '/./s' || (s_suppkey + 1) || '.sh' AS target FROM {supplier} UNION ALL SELECT 'sh/d' || (s_suppkey % 10) || '/s' || s_suppkey || '.sh', CASE WHEN s_suppkey % 3 = 0 THEN '../d' || ((s_suppkey + 8) % 10) || '/s' || (s_suppkey + 8) || '.sh' ELSE './missing.sh' END FROM {supplier}"
SHELL_FUNCTIONS = "SELECT 'file:' || s_suppkey AS file, 'f' || (s_suppkey % 7) AS name, 'fn:' || s_suppkey AS id FROM {supplier}"
SHELL_CALLS = "SELECT 'file:' || s_suppkey AS file, 'fn:' || s_suppkey AS caller, 'f' || ((s_suppkey + 1) % 7) AS callee FROM {supplier} UNION ALL SELECT 'file:' || s_suppkey, 'fn:' || s_suppkey, 'f' || (s_suppkey % 7) FROM {supplier}"


@query("shell_sources", """
WITH l AS (SELECT s.s_suppkey AS a, t.s_suppkey AS b FROM supplier s JOIN supplier t ON t.s_suppkey = s.s_suppkey + 1 OR (s.s_suppkey % 3 = 0 AND t.s_suppkey = s.s_suppkey + 8)),
h AS (SELECT a, min(b) AS b FROM l WHERE b % 7 = (a + 1) % 7 GROUP BY a HAVING count(*) = 1)
SELECT 'file:' || a AS src, 'file:' || b AS dst, 'imports_from' AS relation FROM l UNION ALL SELECT 'fn:' || a, 'fn:' || b, 'calls' FROM h""")
def _(c):
    return resolve.shell_sources(c.sql(SCRIPTS), c.sql(SOURCES), c.sql(SHELL_FUNCTIONS), c.sql(SHELL_CALLS))


EXPORTS = "SELECT 'm' || (c_custkey % 50) AS module, 'n' || (c_custkey % 400) AS name FROM {customer}"
STARS = "SELECT DISTINCT 'm' || (c_custkey % 50) AS module, 'm' || (c_custkey % 50 + 1) AS target FROM {customer} WHERE c_custkey % 5 <> 4"


@query("star_reexports", f"""
WITH e AS (SELECT DISTINCT * FROM ({for_duckdb(EXPORTS)})), s AS ({for_duckdb(STARS)}),
p AS (SELECT module, name, module AS origin, 0 AS far FROM e UNION ALL SELECT s.module, e.name, e.module, 1 FROM s JOIN e ON e.module = s.target
 UNION ALL SELECT s.module, e.name, e.module, 2 FROM s JOIN s t ON t.module = s.target JOIN e ON e.module = t.target UNION ALL SELECT s.module, e.name, e.module, 3 FROM s JOIN s t ON t.module = s.target JOIN s u ON u.module = t.target JOIN e ON e.module = u.target
 UNION ALL SELECT s.module, e.name, e.module, 4 FROM s JOIN s t ON t.module = s.target JOIN s u ON u.module = t.target JOIN s v ON v.module = u.target JOIN e ON e.module = v.target)
SELECT module, name, arg_min(origin, {{'f': far, 'o': origin}}) AS origin FROM p GROUP BY module, name""")
def _(c):
    return resolve.star_reexports(c.sql(EXPORTS), c.sql(STARS))


# ---- pull requests

_STATUS = f"""CASE WHEN base_branch <> 'main' THEN 'WRONG-BASE' WHEN ci_status = 'FAILURE' THEN 'CI-FAIL' WHEN review_decision = 'CHANGES_REQUESTED' THEN 'CHANGES-REQ' WHEN is_draft THEN 'DRAFT'
 WHEN date_diff('day', updated_on, DATE '{TODAY}') >= 14 THEN 'STALE' WHEN review_decision = 'APPROVED' THEN 'APPROVED' WHEN ci_status = 'PENDING' THEN 'PENDING' ELSE 'READY' END"""


@query("pr_order", f"SELECT number, status, list_position({prs.STATUSES}, status) AS place, updated_on FROM (SELECT number, updated_on, {_STATUS} AS status FROM prs)", "prs")
def _(c):
    return prs.in_order(c.prs, "main", TODAY).select("number", "status", F.col("place").cast("int").alias("place"), "updated_on")
