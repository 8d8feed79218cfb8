"""Queries of the analysis family, on the foreign-key graph with its region communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyze, build
from .base import query

SKIP = "('imports', 'imports_from', 'contains', 'method')"
CAT = "CASE WHEN {0} IN ('py','go','java','ts') THEN 'code' WHEN {0} = 'pdf' THEN 'paper' WHEN {0} IN ('png','jpg') THEN 'image' ELSE 'doc' END"
FAM = "CASE {0} WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'java' THEN 'jvm' WHEN 'ts' THEN 'js' END"


def simple(c):
    return build.collapse_edges(c.edges)


def rich(c, s=None):
    return analyze.rich_nodes(c.nodes, s if s is not None else simple(c))


@query("degree", "SELECT id, degree FROM deg", "deg")
def _(c):
    return analyze.degree(simple(c))


@query("god_nodes", "SELECT id, label, degree FROM rich WHERE NOT is_file AND NOT is_concept AND NOT is_json_key ORDER BY degree DESC, id LIMIT 10", "rich")
def _(c):
    return analyze.god_nodes(rich(c))


# some nodes get labels and files that the predicates look for
MASKED = "SELECT id, CASE WHEN id LIKE 'customer:%0' THEN 'customer_0.py' WHEN id LIKE 'customer:%1' THEN '.' || label || '()' WHEN id LIKE 'order:%2' THEN label || '()' WHEN id LIKE 'part:%3' THEN 'Dependencies' ELSE label END AS label, file_type, CASE WHEN id LIKE 'part:%3' THEN 'conf/app.json' WHEN id LIKE 'part:%4' THEN 'ideas' ELSE source_file END AS source_file, community FROM nodes"


@query("file_nodes", f"""
WITH m AS ({MASKED}), r AS (SELECT m.*, coalesce(degree, 0) AS degree FROM m LEFT JOIN deg USING (id))
SELECT id, label <> '' AND (label = regexp_extract(source_file, '[^/]*$') OR (starts_with(label, '.') AND ends_with(label, '()')) OR (ends_with(label, '()') AND degree <= 1)) AS is_file,
 coalesce(source_file, '') = '' OR NOT contains(regexp_extract(source_file, '[^/]*$'), '.') AS is_concept, ends_with(source_file, '.json') AND lower(label) = 'dependencies' AS is_json_key FROM r""", "nodes", "deg")
def _(c):
    from .build_queries import view

    return analyze.rich_nodes(view(c, MASKED), simple(c)).select("id", "is_file", "is_concept", "is_json_key")


_SCORED = f"""
WITH x AS (SELECT s.*, a.label AS source, b.label AS target, a.source_file AS s_file, b.source_file AS d_file, a.community AS ca, b.community AS cb, a.degree AS da, b.degree AS db,
  regexp_extract(a.source_file, '[^.]*$') AS sx, regexp_extract(b.source_file, '[^.]*$') AS dx
 FROM simple s JOIN rich a ON a.id = s.src JOIN rich b ON b.id = s.dst WHERE relation NOT IN {SKIP} AND NOT (a.is_file OR a.is_concept OR b.is_file OR b.is_concept) AND a.source_file <> b.source_file),
y AS (SELECT *, {CAT.format('sx')} AS cs, {CAT.format('dx')} AS cd, {FAM.format('sx')} AS fs, {FAM.format('dx')} AS fd FROM x),
z AS (SELECT *, confidence = 'INFERRED' AND relation IN ('calls', 'uses') AND (coalesce(fs <> fd, false) OR (cs = 'code' AND cd = 'doc') OR (cs = 'doc' AND cd = 'code')) AS mute FROM y),
scored AS (SELECT src, dst, source, target, s_file, d_file, relation, confidence, CAST(CASE WHEN mute THEN 0 WHEN confidence = 'AMBIGUOUS' THEN 3 WHEN confidence = 'INFERRED' THEN 2 ELSE 1 END
 + CASE WHEN mute THEN 0 ELSE CASE WHEN cs <> cd THEN 2 ELSE 0 END + CASE WHEN split_part(s_file, '/', 1) <> split_part(d_file, '/', 1) THEN 2 ELSE 0 END + CASE WHEN ca <> cb THEN 1 ELSE 0 END END
 + CASE WHEN least(da, db) <= 2 AND greatest(da, db) >= 5 THEN 1 ELSE 0 END AS BIGINT) AS score FROM z)
"""


@query("surprise_scores", _SCORED + "SELECT * FROM scored", "simple", "rich")
def _(c):
    s = simple(c)
    return analyze.surprise_scores(rich(c, s), s)


@query("surprising_connections", _SCORED + "SELECT * FROM scored ORDER BY score DESC, src, dst LIMIT 5", "simple", "rich")
def _(c):
    s = simple(c)
    return analyze.surprising_connections(analyze.surprise_scores(rich(c, s), s))


@query("community_bridges", f"""
WITH e AS (SELECT s.*, a.label AS source, b.label AS target, least(a.community, b.community) AS com_a, greatest(a.community, b.community) AS com_b, CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 WHEN 'EXTRACTED' THEN 2 ELSE 3 END AS rank
 FROM simple s JOIN rich a ON a.id = s.src JOIN rich b ON b.id = s.dst WHERE relation NOT IN {SKIP} AND NOT a.is_file AND NOT b.is_file AND a.community <> b.community),
r AS (SELECT *, row_number() OVER (PARTITION BY com_a, com_b ORDER BY rank, src, dst) AS nth FROM e)
SELECT com_a, com_b, src, dst, source, target, relation, confidence FROM r WHERE nth = 1 ORDER BY rank, src, dst LIMIT 5""", "simple", "rich")
def _(c):
    s = simple(c)
    return analyze.community_bridges(rich(c, s), s)


_COHESION = """SELECT n.community, size, coalesce(intra, 0) AS intra, round(CASE WHEN size <= 1 THEN 1.0 ELSE coalesce(intra, 0) / (size * (size - 1) / 2.0) END, 8) AS cohesion
FROM (SELECT community, count(*) AS size FROM nodes GROUP BY 1) n LEFT JOIN (SELECT a.community, count(*) AS intra FROM simple JOIN nodes a ON a.id = lo JOIN nodes b ON b.id = hi WHERE a.community = b.community GROUP BY 1) i USING (community)"""


@query("cohesion", _COHESION, "nodes", "simple")
def _(c):
    return analyze.cohesion(c.nodes, simple(c))


@query("confidence_audit", """
SELECT confidence, count(*) AS edges, CAST(round_even(count(*) * 100.0 / (SELECT count(*) FROM edges), 0) AS BIGINT) AS percent, round(avg(CASE WHEN confidence = 'INFERRED' THEN coalesce(confidence_score, 0.5) END), 6) AS mean_score FROM edges GROUP BY confidence""", "edges")
def _(c):
    return analyze.confidence_mix(c.edges)


@query("graph_stats", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM simple) AS edges, (SELECT count(DISTINCT community) FROM nodes) AS communities, (SELECT count(*) FROM simple WHERE confidence = 'EXTRACTED') AS extracted, (SELECT count(*) FROM simple WHERE confidence = 'INFERRED') AS inferred, (SELECT count(*) FROM simple WHERE confidence = 'AMBIGUOUS') AS ambiguous", "nodes", "simple")
def _(c):
    n = c.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("community").alias("communities"))
    e = simple(c).agg(F.count(F.lit(1)).alias("edges"), *(F.count_if(F.col("confidence") == k.upper()).alias(k) for k in ("extracted", "inferred", "ambiguous")))
    return n.join(F.broadcast(e)).select("nodes", "edges", "communities", "extracted", "inferred", "ambiguous")


@query("knowledge_gaps", """
SELECT 'weak_node' AS kind, id AS key FROM rich WHERE degree <= 1 AND NOT is_file AND NOT is_concept AND file_type <> 'rationale'
UNION ALL SELECT 'thin_community', CAST(community AS VARCHAR) FROM rich WHERE NOT is_file GROUP BY community HAVING count(*) < 3""", "rich")
def _(c):
    return analyze.knowledge_gaps(rich(c))


@query("suggested_questions", f"""
WITH q1 AS (SELECT 1 AS family, src || '|' || dst AS o, 'What is the exact relationship between `' || a.label || '` and `' || b.label || '`?' AS question FROM simple JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE confidence = 'AMBIGUOUS' ORDER BY src, dst LIMIT 7),
b AS (SELECT id, label, community, degree FROM rich WHERE NOT is_file AND NOT is_concept AND degree > 0 ORDER BY degree DESC, id LIMIT 3),
bq AS (SELECT 2, lpad(CAST(CAST(1000000000000 - degree AS DECIMAL(20, 6)) AS VARCHAR), 24, '0') || id, 'Why does `' || label || '` connect `Community ' || community || '` to ' || (SELECT string_agg('`Community ' || oc || '`', ', ' ORDER BY oc) FROM (SELECT DISTINCT n.community AS oc FROM nbr JOIN nodes n ON n.id = other WHERE nbr.id = b.id AND n.community <> b.community)) || '?' AS question FROM b),
h AS (SELECT id, label, degree FROM rich WHERE NOT is_file ORDER BY degree DESC, id LIMIT 5),
q2 AS (SELECT 3, lpad(CAST(1000000000 - degree AS VARCHAR), 12, '0') || id, 'Are the ' || count(*) || ' inferred relationships involving `' || label || '` actually correct?' FROM nbr JOIN h USING (id) WHERE confidence = 'INFERRED' GROUP BY id, label, degree HAVING count(*) >= 2),
w AS (SELECT count(*) AS n, arg_min(label, id) AS l FROM rich WHERE degree <= 1 AND NOT is_file AND NOT is_concept),
co AS ({_COHESION}),
q AS (SELECT * FROM q1 UNION ALL SELECT * FROM bq WHERE question IS NOT NULL UNION ALL SELECT * FROM q2 UNION ALL SELECT 4, '', 'What connects `' || l || '` and ' || (n - 1) || ' more to the rest of the system?' FROM w WHERE n > 0
 UNION ALL SELECT 5, lpad(CAST(community AS VARCHAR), 12, '0'), 'Should `Community ' || community || '` be split into smaller, more focused modules?' FROM co WHERE cohesion < 0.15 AND size >= 5)
SELECT family, question FROM q ORDER BY family, o LIMIT 7""", "nodes", "simple", "rich", "nbr")
def _(c):
    """Degrees stand in for betweenness, which SQL can't express; all rows are read."""
    s = simple(c)
    r = rich(c, s)
    return analyze.suggested_questions(r, s, between=r.select("id", F.col("degree").alias("score")))


@query("dominant_confidence", "SELECT id, confidence FROM (SELECT id, confidence, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, confidence) AS r FROM nbr GROUP BY id, confidence) WHERE r = 1", "nbr")
def _(c):
    return analyze.dominant_confidence(simple(c))


@query("community_reach", "SELECT nbr.id, count(DISTINCT b.community) AS reach FROM nbr JOIN nodes a ON a.id = nbr.id JOIN nodes b ON b.id = other WHERE a.community <> b.community GROUP BY nbr.id", "nodes", "nbr")
def _(c):
    return analyze.community_reach(c.nodes, simple(c))


@query("cross_community_links", "SELECT a.community, b.community AS other, count(*) AS links FROM nbr JOIN nodes a ON a.id = nbr.id JOIN nodes b ON b.id = other WHERE a.community <> b.community GROUP BY ALL", "nodes", "nbr")
def _(c):
    return analyze.cross_community_links(c.nodes, simple(c))


@query("community_meta_edges", "SELECT least(a.community, b.community) AS com_a, greatest(a.community, b.community) AS com_b, count(*) AS edges FROM simple JOIN nodes a ON a.id = lo JOIN nodes b ON b.id = hi WHERE a.community <> b.community GROUP BY ALL", "nodes", "simple")
def _(c):
    return analyze.community_meta_edges(c.nodes, simple(c))


@query("community_articles", "SELECT community, CAST(r AS INTEGER) AS rank, id, label, degree FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS r FROM rich) WHERE r <= 25", "rich")
def _(c):
    return analyze.community_articles(rich(c))


@query("community_ids", "SELECT community, size, CAST(row_number() OVER (ORDER BY size DESC, f) - 1 AS INTEGER) AS rank FROM (SELECT community, count(*) AS size, min(id) AS f FROM nodes GROUP BY 1)", "nodes")
def _(c):
    return analyze.community_ids(c.nodes)


@query("community_overlap", "SELECT community AS old_community, CAST(length(label) % 6 AS INTEGER) AS new_community, count(*) AS overlap FROM nodes GROUP BY ALL", "nodes")
def _(c):
    return analyze.community_overlap(c.nodes, c.nodes.withColumn("community", (F.length("label") % 6).cast("int")))


_HUBS = "h AS (SELECT id, degree FROM deg WHERE degree > (SELECT degree FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i FROM deg) WHERE i = greatest(0, CAST(floor((SELECT count(*) FROM deg) * 0.99) AS BIGINT) - 1)))"


@query("hub_nodes", f"WITH {_HUBS} SELECT * FROM h", "deg")
def _(c):
    return analyze.hub_nodes(analyze.degree(simple(c)))


@query("hub_reattach", f"""
WITH {_HUBS}, v AS (SELECT nbr.id, n.community, count(*) AS c FROM nbr JOIN h USING (id) JOIN nodes n ON n.id = other WHERE other NOT IN (SELECT id FROM h) GROUP BY ALL)
SELECT id, community FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, community) AS r FROM v) WHERE r = 1""", "nodes", "deg", "nbr")
def _(c):
    s = simple(c)
    return analyze.hub_reattach(analyze.hub_nodes(analyze.degree(s)), s, c.nodes)


@query("hyperedge_rollup", """
WITH h AS (SELECT DISTINCT src AS hid, dst AS member FROM edges WHERE relation = 'calls')
SELECT hid AS id, string_agg(CAST(community AS VARCHAR), ',' ORDER BY community) AS communities FROM (SELECT DISTINCT hid, community FROM h JOIN nodes ON id = member) GROUP BY hid HAVING count(*) >= 2""", "nodes", "edges")
def _(c):
    h = c.edges.filter("relation = 'calls'").groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("members"))
    return analyze.hyperedge_rollup(h, c.nodes)


@query("community_label_inputs", """
WITH o AS (SELECT community, lower(label) AS l, arg_max(label, {'d': degree, 'i': id}) AS label, max(degree) AS degree FROM rich GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, l) AS r FROM o)
SELECT community, (SELECT count(*) FROM nodes n WHERE n.community = t.community) AS size, string_agg(label, ', ' ORDER BY r) AS labels FROM t WHERE r <= 12 GROUP BY community""", "nodes", "rich")
def _(c):
    return analyze.community_label_inputs(rich(c))


@query("token_reduction", """
WITH w AS (SELECT len(regexp_split_to_array(trim(content, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '\\s+')) AS words FROM files WHERE trim(content, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> ''),
q AS (SELECT CAST(floor(avg(greatest(1, chars // 4))) AS BIGINT) AS query_tokens FROM (SELECT community, sum(length(label)) AS chars FROM nodes GROUP BY 1)),
c AS (SELECT CAST(sum(words) * 100 // 75 AS BIGINT) AS corpus_tokens FROM w)
SELECT corpus_tokens, query_tokens, round(corpus_tokens / query_tokens, 1) AS ratio FROM c, q""", "nodes", "files")
def _(c):
    from ..operators.detect import word_count

    words = c.files.select(word_count(F.col("content")).alias("words"))
    return analyze.token_reduction(words, c.nodes.groupBy("community").agg(F.sum(F.length("label")).alias("chars")))
