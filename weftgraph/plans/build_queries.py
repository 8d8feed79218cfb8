"""Queries of the build family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import build, diagnostics
from ..sinks import cypher
from .base import query

# Variants of the foreign-key graph that exercise repairs.  The same texts in both dialects.
RAW_NODES = "SELECT id, label, CASE WHEN id LIKE 'part:%1' THEN 'tool' WHEN id LIKE 'part:%2' THEN 'markdown' WHEN id LIKE 'part:%3' THEN 'gotcha' WHEN id LIKE 'part:%4' THEN '' WHEN id LIKE 'part:%5' THEN 'mystery' ELSE file_type END AS file_type, CASE WHEN id LIKE 'supplier:%' THEN NULL ELSE source_file END AS source_file, source_file AS source FROM nodes"
BAD_NODES = "SELECT CASE WHEN id LIKE 'region:3' THEN NULL ELSE id END AS id, CASE WHEN id LIKE 'nation:1%' THEN NULL ELSE label END AS label, CASE WHEN id LIKE 'nation:2%' THEN 'table' ELSE file_type END AS file_type, source_file FROM nodes"
BAD_EDGES = "SELECT CASE WHEN src LIKE 'nation:7' THEN NULL ELSE src END AS src, CASE WHEN dst LIKE 'supplier:%9' THEN dst || 'x' ELSE dst END AS dst, relation, CASE WHEN src LIKE 'customer:%77' THEN 'MAYBE' ELSE confidence END AS confidence, context, source_file FROM edges"
ODD_ENDS = "SELECT CASE ord % 4 WHEN 0 THEN upper(src) WHEN 1 THEN '  ' || src ELSE src END AS src, CASE WHEN ord % 9 = 0 THEN dst || '?!' WHEN ord % 9 = 1 THEN 'none:' || dst ELSE dst END AS dst, relation, confidence, source_file, ord FROM edges"
MUTUAL = "SELECT src, dst, relation, confidence, confidence_score, context, weight, source_file, ord FROM edges UNION ALL SELECT dst, src, CASE WHEN ord % 3 = 0 THEN relation WHEN ord % 3 = 1 THEN 'about' ELSE 'zoned' END, 'INFERRED', 0.25, NULL, weight + 1, source_file, ord + 5 FROM edges WHERE ord % 5 = 0"
NEW_NODES = "SELECT id, label || ' v2' AS label, CASE WHEN community = 2 THEN NULL ELSE file_type END AS file_type, source_file, community + 1 AS community, 1 AS ord FROM nodes WHERE id LIKE 'customer:%3' UNION ALL SELECT 'extra:' || id, label, 'concept', 'notes/extra.md', 9, 2 FROM nodes WHERE id LIKE 'nation:%'"
OLD_NODES = "SELECT id, label, file_type, source_file, community, 0 AS ord FROM nodes WHERE id NOT LIKE 'order:%'"


def view(cat, sql, **frames):
    for name in ("nodes", "edges"):
        frames.setdefault(name, getattr(cat, name))
    import re

    text = re.sub(r"\b(nodes|edges)\b", r"{\1}", sql)
    used = {k: v for k, v in frames.items() if "{" + k + "}" in text}
    return cat.spark.sql(text, **used)


@query("canonical_file_type", f"""
WITH raw AS ({RAW_NODES}) SELECT id, CASE WHEN coalesce(file_type, '') = '' THEN 'concept' WHEN file_type IN ('code','document','paper','image','rationale','concept') THEN file_type
 WHEN file_type IN ('markdown','text') THEN 'document' WHEN file_type IN ('tool','library') THEN 'code' ELSE 'concept' END AS file_type, coalesce(source_file, source) AS source_file FROM raw""", "nodes")
def _(c):
    return build.canonical_nodes(view(c, RAW_NODES)).select("id", "file_type", "source_file")


@query("validation_errors", f"""
WITH n AS ({BAD_NODES}), e AS ({BAD_EDGES}), k AS (SELECT *, coalesce(src, '?') || '->' || coalesce(dst, '?') AS key FROM e)
SELECT 'node_missing' AS kind, coalesce(id, '?') AS row_id, f AS detail FROM (SELECT id, unnest([CASE WHEN id IS NULL THEN 'id' END, CASE WHEN label IS NULL THEN 'label' END, CASE WHEN file_type IS NULL THEN 'file_type' END, CASE WHEN source_file IS NULL THEN 'source_file' END]) AS f FROM n) WHERE f IS NOT NULL
UNION ALL SELECT 'node_file_type', coalesce(id, '?'), file_type FROM n WHERE file_type NOT IN ('code','document','paper','image','rationale','concept')
UNION ALL SELECT 'edge_missing', key, f FROM (SELECT key, unnest([CASE WHEN src IS NULL THEN 'src' END, CASE WHEN dst IS NULL THEN 'dst' END, CASE WHEN relation IS NULL THEN 'relation' END, CASE WHEN confidence IS NULL THEN 'confidence' END, CASE WHEN source_file IS NULL THEN 'source_file' END]) AS f FROM k) WHERE f IS NOT NULL
UNION ALL SELECT 'edge_confidence', key, confidence FROM k WHERE confidence NOT IN ('EXTRACTED','INFERRED','AMBIGUOUS')
UNION ALL SELECT 'edge_dangling', key, 'src' FROM k WHERE src IS NOT NULL AND src NOT IN (SELECT id FROM n WHERE id IS NOT NULL)
UNION ALL SELECT 'edge_dangling', key, 'dst' FROM k WHERE dst IS NOT NULL AND dst NOT IN (SELECT id FROM n WHERE id IS NOT NULL)""", "nodes", "edges")
def _(c):
    return build.validation_errors(view(c, BAD_NODES), view(c, BAD_EDGES))


@query("dangling_edges", f"WITH e AS ({BAD_EDGES}) SELECT src, dst, relation, count(*) AS edges FROM e WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY ALL", "nodes", "edges")
def _(c):
    return build.prune_dangling(c.nodes, view(c, BAD_EDGES)).groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("edges"))


_NORM = "trim(lower(regexp_replace(regexp_replace({}, '[^\\w]+', '_', 'g'), '_+', '_', 'g')), '_')"


@query("endpoint_repair", f"""
WITH e AS ({ODD_ENDS}), m AS (SELECT {_NORM.format('id')} AS k, min(id) AS id FROM nodes GROUP BY 1),
r AS (SELECT coalesce(n1.id, m1.id) AS src, coalesce(n2.id, m2.id) AS dst, relation, e.ord AS ord FROM e
 LEFT JOIN nodes n1 ON n1.id = e.src LEFT JOIN m m1 ON m1.k = {_NORM.format('e.src')} LEFT JOIN nodes n2 ON n2.id = e.dst LEFT JOIN m m2 ON m2.k = {_NORM.format('e.dst')})
SELECT src, dst, relation, count(*) AS edges FROM r WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL""", "nodes", "edges")
def _(c):
    return build.repair_endpoints(c.nodes, view(c, ODD_ENDS)).groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("edges"))


_FAM = "CASE WHEN x IN ('py','pyi') THEN 'py' WHEN x IN ('js','mjs','cjs','jsx','ts','tsx') THEN 'js' WHEN x = 'go' THEN 'go' WHEN x IN ('java','kt','scala','groovy') THEN 'jvm' END"


@query("phantom_calls", f"""
WITH f AS (SELECT id, lower(regexp_extract(source_file, '[^/]+\\.([^./]+)$', 1)) AS x FROM nodes), g AS (SELECT id, x, {_FAM} AS fam FROM f)
SELECT e.src, e.dst, count(*) AS edges FROM edges e LEFT JOIN g a ON a.id = e.src LEFT JOIN g b ON b.id = e.dst
WHERE relation = 'calls' AND NOT (confidence = 'INFERRED' AND a.x <> '' AND b.x <> '' AND a.fam IS DISTINCT FROM b.fam) GROUP BY ALL""", "nodes", "edges")
def _(c):
    return build.drop_phantom_calls(c.nodes, c.edges).filter("relation = 'calls'").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("edges"))


@query("collapse_edges", f"""
WITH m AS ({MUTUAL}),
w AS (SELECT *, src > dst AS back, least(src, dst) AS lo, greatest(src, dst) AS hi FROM m),
x AS (SELECT *, max(CASE WHEN NOT back THEN relation END) OVER p AS rf, min(CASE WHEN back THEN relation END) OVER p AS rb FROM w WINDOW p AS (PARTITION BY lo, hi)),
y AS (SELECT *, {{'b': back, 'r': relation, 'o': ord}} AS o FROM x WHERE NOT coalesce(back AND relation = rf AND rf = rb, false))
SELECT arg_max(src, o) AS src, arg_max(dst, o) AS dst, arg_max(relation, o) AS relation, arg_max(confidence, o) AS confidence, arg_max(confidence_score, o) FILTER (confidence_score IS NOT NULL) AS confidence_score,
 arg_max(context, o) FILTER (context IS NOT NULL) AS context, arg_max(weight, o) AS weight FROM y GROUP BY lo, hi""", "edges")
def _(c):
    return build.collapse_edges(view(c, MUTUAL)).select("src", "dst", "relation", "confidence", "confidence_score", "context", "weight")


@query("collapse_directed", "SELECT src, dst, arg_max(relation, {'r': relation, 'o': ord}) AS relation, arg_max(confidence, {'r': relation, 'o': ord}) AS confidence, arg_max(weight, {'r': relation, 'o': ord}) AS weight FROM edges GROUP BY src, dst", "edges")
def _(c):
    return build.collapse_edges(c.edges, directed=True).select("src", "dst", "relation", "confidence", "weight")


@query("upsert_last", f"""
WITH b AS (SELECT *, 0 AS g FROM ({OLD_NODES}) UNION ALL SELECT *, 1 FROM ({NEW_NODES}))
SELECT id, arg_max(label, g) AS label, arg_max(file_type, g) FILTER (file_type IS NOT NULL) AS file_type, arg_max(community, g) AS community FROM b GROUP BY id""", "nodes")
def _(c):
    return build.upsert_nodes(view(c, OLD_NODES), view(c, NEW_NODES)).select("id", "label", "file_type", "community")


@query("upsert_first", f"""
WITH b AS (SELECT *, 0 AS g FROM ({OLD_NODES}) UNION ALL SELECT *, 1 FROM ({NEW_NODES}))
SELECT id, label, file_type, community FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY g, ord) AS r FROM b) WHERE r = 1""", "nodes")
def _(c):
    return build.upsert_nodes(view(c, OLD_NODES), view(c, NEW_NODES), "first").select("id", "label", "file_type", "community")


@query("build_merge", f"""
WITH b AS (SELECT *, 0 AS g FROM ({OLD_NODES}) UNION ALL SELECT *, 1 FROM ({NEW_NODES})),
n AS (SELECT id, source_file FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY g, ord) AS r FROM b) WHERE r = 1 AND source_file NOT LIKE 'catalog/part_1%'),
e AS (SELECT * FROM edges WHERE source_file NOT LIKE 'catalog/part_1%' AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))
SELECT 'node' AS kind, source_file, count(*) AS rows FROM n GROUP BY ALL UNION ALL SELECT 'edge', source_file, count(*) FROM e GROUP BY ALL""", "nodes", "edges")
def _(c):
    gone = c.nodes.select("source_file").distinct().filter("source_file LIKE 'catalog/part_1%'")
    half = c.edges.filter("ord % 2 = 0"), c.edges.filter("ord % 2 <> 0")
    n, e = build.build_merge(view(c, OLD_NODES), half[0], view(c, NEW_NODES), half[1], gone)
    count = lambda df, kind: df.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("kind"), "source_file", "rows")
    return count(n, "node").union(count(e, "edge"))


@query("compose", f"""
SELECT coalesce(a.id, b.id) AS id, coalesce(b.label, a.label) AS label, coalesce(b.file_type, a.file_type) AS file_type, coalesce(b.community, a.community) AS community
FROM ({OLD_NODES}) a FULL JOIN ({NEW_NODES}) b ON a.id = b.id""", "nodes")
def _(c):
    return build.compose(view(c, OLD_NODES).drop("ord"), view(c, NEW_NODES).drop("ord"), ["id"]).select("id", "label", "file_type", "community")


@query("prefix_union", "SELECT 'east::' || id AS id, 'east' AS repo, id AS local_id, label FROM nodes WHERE community <= 2 UNION ALL SELECT 'west::' || id, 'west', id, label FROM nodes WHERE community >= 2", "nodes")
def _(c):
    return build.prefix_graph(c.nodes.filter("community <= 2"), "east").unionByName(build.prefix_graph(c.nodes.filter("community >= 2"), "west")).select("id", "repo", "local_id", "label")


@query("global_add", """
WITH g AS (SELECT id, label, CASE WHEN id LIKE 'part:%' AND id NOT LIKE '%5' THEN '' ELSE source_file END AS source_file FROM nodes WHERE id LIKE '%:%7' OR id LIKE 'part:1%'),
n AS (SELECT id, label, CASE WHEN id LIKE 'part:%' THEN NULL ELSE source_file END AS source_file FROM nodes),
f AS (SELECT * FROM n WHERE coalesce(source_file, '') <> '' OR lower(label) NOT IN (SELECT lower(label) FROM g WHERE coalesce(source_file, '') = ''))
SELECT src, dst, relation, count(*) AS edges FROM edges WHERE src IN (SELECT id FROM f) AND dst IN (SELECT id FROM f) GROUP BY ALL""", "nodes", "edges")
def _(c):
    known = c.nodes.filter("id LIKE '%:%7' OR id LIKE 'part:1%'").withColumn("source_file", F.expr("CASE WHEN id LIKE 'part:%' AND id NOT LIKE '%5' THEN '' ELSE source_file END"))
    new = c.nodes.withColumn("source_file", F.expr("CASE WHEN id LIKE 'part:%' THEN NULL ELSE source_file END"))
    return build.global_add(known, new, c.edges)[1].groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("edges"))


STUBS = "SELECT CASE WHEN id LIKE 'part:%' THEN id ELSE id END AS id, CASE WHEN id LIKE 'supplier:%' THEN 'Supplier Kind ' || community ELSE label END AS label, 'code' AS file_type, CASE WHEN id LIKE 'supplier:%' AND id NOT LIKE 'supplier:1' THEN NULL ELSE source_file END AS source_file FROM nodes"


@query("stub_rewire", f"""
WITH s AS ({STUBS}), k AS (SELECT *, lower(regexp_replace(label, '[^a-zA-Z0-9]+', '', 'g')) AS key FROM s),
u AS (SELECT key, min(id) AS dest FROM k WHERE NOT ends_with(label, ')') AND NOT contains(label, '.') AND coalesce(source_file, '') <> '' AND key <> '' GROUP BY key HAVING count(*) = 1),
m AS (SELECT id, dest FROM k JOIN u USING (key) WHERE coalesce(source_file, '') = ''),
r AS (SELECT coalesce(a.dest, src) AS src, coalesce(b.dest, dst) AS dst, relation FROM edges LEFT JOIN m a ON a.id = src LEFT JOIN m b ON b.id = dst)
SELECT src, dst, relation, count(*) AS edges FROM r WHERE src <> dst GROUP BY ALL""", "nodes", "edges")
def _(c):
    return build.stub_rewire(view(c, STUBS), c.edges).groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("edges"))


TWINS = "SELECT id, label, source_file FROM nodes UNION ALL SELECT id, label, 'copy/' || source_file FROM nodes WHERE id LIKE 'customer:%4'"


@query("disambiguate_ids", f"""
WITH n AS ({TWINS}), m AS (SELECT id FROM n GROUP BY id HAVING count(DISTINCT source_file) > 1),
x AS (SELECT CASE WHEN m.id IS NULL THEN n.id ELSE {_NORM.format("n.source_file || '_' || n.id")} END AS id, label FROM n LEFT JOIN m USING (id)),
e AS (SELECT CASE WHEN m1.id IS NULL OR o1.source_file IS NULL THEN src ELSE {_NORM.format("e.source_file || '_' || src")} END AS src, dst FROM edges e LEFT JOIN m m1 ON m1.id = src LEFT JOIN n o1 ON o1.id = src AND o1.source_file = e.source_file WHERE relation = 'references')
SELECT 'node' AS kind, id AS a, label AS b, count(*) AS rows FROM x GROUP BY ALL UNION ALL SELECT 'edge', src, dst, count(*) FROM e GROUP BY ALL""", "nodes", "edges")
def _(c):
    n, e = build.disambiguate_ids(view(c, TWINS), c.edges.filter("relation = 'references'"))
    return n.groupBy("id", "label").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), "rows").union(e.groupBy("src", "dst").agg(F.count(F.lit(1))).select(F.lit("edge"), "src", "dst", "count(1)"))


@query("edge_score_defaults", "SELECT relation, confidence, coalesce(confidence_score, CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.5 WHEN 'AMBIGUOUS' THEN 0.2 ELSE 0.5 END) AS confidence_score, count(*) AS edges FROM edges GROUP BY ALL", "edges")
def _(c):
    return build.score_defaults(c.edges).groupBy("relation", "confidence", "confidence_score").agg(F.count(F.lit(1)).alias("edges"))


@query("graph_diff_nodes", f"""
WITH o AS ({OLD_NODES}), w AS (SELECT * FROM o WHERE id NOT LIKE 'part:%8' UNION ALL SELECT * FROM ({NEW_NODES}) WHERE id LIKE 'extra:%')
SELECT 'added' AS change, id, label FROM w WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT 'removed', id, label FROM o WHERE id NOT IN (SELECT id FROM w)""", "nodes")
def _(c):
    old = view(c, OLD_NODES)
    return build.diff_nodes(old, old.filter("id NOT LIKE 'part:%8'").unionByName(view(c, NEW_NODES).filter("id LIKE 'extra:%'")))


@query("graph_diff_edges", """
WITH o AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v, relation FROM edges WHERE ord % 4 <> 0), w AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v, relation FROM edges WHERE ord % 4 <> 1)
SELECT 'added' AS change, * FROM (SELECT * FROM w EXCEPT SELECT * FROM o) UNION ALL SELECT 'removed', * FROM (SELECT * FROM o EXCEPT SELECT * FROM w)""", "edges")
def _(c):
    return build.diff_edges(c.edges.filter("ord % 4 <> 0"), c.edges.filter("ord % 4 <> 1"))


LABELS = "SELECT id, chr(7) || label || chr(10) || repeat('x', CAST(community * 40 AS INT)) AS label FROM nodes"


@query("sanitized_labels", f"SELECT id, substr(regexp_replace(label, '[\\x00-\\x1F\\x7F]', '', 'g'), 1, 256) AS label FROM ({LABELS})", "nodes")
def _(c):
    return build.sanitize_labels(view(c, LABELS))


WORDY = "SELECT id, CASE WHEN id LIKE 'customer:%2' THEN 'Chosen because: the account of ' || label || ' is settled in this place every month.' ELSE label END AS label, CASE WHEN id LIKE 'customer:%5' THEN 'concept' ELSE file_type END AS file_type, source_file FROM nodes"
TOLD = "SELECT src, dst, CASE WHEN src LIKE 'customer:%' THEN 'rationale_for' ELSE relation END AS relation, source_file FROM edges WHERE relation IN ('references', 'contains')"


@query("rationale_fold", f"""
WITH n AS ({WORDY}), e AS ({TOLD}),
p AS (SELECT n.id, label, dst FROM n JOIN e ON e.src = n.id AND e.relation = 'rationale_for' WHERE (length(label) >= 80 OR len(regexp_split_to_array(trim(label), '\\s+')) >= 8) AND regexp_matches(label, '[.!?:]')),
g AS (SELECT id FROM p UNION SELECT id FROM n WHERE file_type IN ('rationale', 'concept')),
l AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM g))
SELECT l.id, coalesce(r.rationale, '') AS rationale, (SELECT count(*) FROM e WHERE src IN (SELECT id FROM l) AND dst IN (SELECT id FROM l)) AS edges
FROM l LEFT JOIN (SELECT dst, string_agg(label, '|' ORDER BY label) AS rationale FROM p GROUP BY dst) r ON r.dst = l.id""", "nodes", "edges")
def _(c):
    n, e = build.fold_rationale(view(c, WORDY), view(c, TOLD))
    total = e.agg(F.count(F.lit(1)).alias("edges"))
    return n.select("id", F.coalesce(F.array_join("rationale", "|"), F.lit("")).alias("rationale")).join(F.broadcast(total))


@query("edge_diagnostics", f"""
WITH e AS ({BAD_EDGES}), f AS (SELECT *, src IN (SELECT id FROM nodes) AS s, dst IN (SELECT id FROM nodes) AS d FROM e), g AS (SELECT * FROM f WHERE src IS NOT NULL AND dst IS NOT NULL AND s AND d),
x AS (SELECT count(*) AS c FROM g GROUP BY src, dst, relation, confidence, context, source_file), y AS (SELECT src, dst, count(*) AS c FROM g GROUP BY src, dst), z AS (SELECT sum(c) AS c FROM y GROUP BY least(src, dst), greatest(src, dst))
SELECT count(*) AS total, count(*) FILTER (src IS NULL OR dst IS NULL) AS missing_endpoint, count(*) FILTER (src IS NOT NULL AND dst IS NOT NULL AND NOT (s AND d)) AS dangling, count(*) FILTER (src = dst) AS self_loops,
 (SELECT count(*) FROM g) AS valid, (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM x) AS exact_duplicates, (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM y) AS directed_collapse, (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM z) AS undirected_collapse FROM f""", "nodes", "edges")
def _(c):
    return diagnostics.edge_diagnostics(c.nodes, view(c, BAD_EDGES))


@query("same_endpoint_groups", f"""
SELECT src, dst, count(*) AS edges, count(DISTINCT relation) AS relations, count(DISTINCT confidence) AS confidences, count(DISTINCT source_file) AS files, count(DISTINCT coalesce(context, '')) AS contexts
FROM ({MUTUAL}) GROUP BY src, dst HAVING count(*) > 1 ORDER BY edges DESC, src, dst LIMIT 10""", "edges")
def _(c):
    return diagnostics.same_endpoint_groups(view(c, MUTUAL))


@query("cypher_statements", """
SELECT 'MERGE (n:' || upper(file_type[1]) || substr(file_type, 2) || ' {id: ''' || replace(id, '''', '\\''') || ''', label: ''' || replace(label, '''', '\\''') || '''});' AS statement FROM nodes
UNION ALL SELECT 'MATCH (a {id: ''' || src || '''}), (b {id: ''' || dst || '''}) MERGE (a)-[:' || upper(relation) || ' {confidence: ''' || confidence || '''}]->(b);' FROM simple""", "nodes", "simple")
def _(c):
    return cypher.statements(c.nodes, build.collapse_edges(c.edges))


FRAGMENT = "SELECT id, label, file_type, source_file FROM nodes WHERE id LIKE 'nation:%' OR id LIKE 'region:%'"


@query("canonical_edges", "SELECT src, dst, relation, count(*) AS edges FROM (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, relation FROM edges) GROUP BY ALL", "edges")
def _(c):
    u, v, r = build.edge_signature(False)
    return c.edges.select(u.alias("src"), v.alias("dst"), r).groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("edges"))
