"""Queries of search and traversal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyze, build, resolve, search, traverse
from .base import query

QUESTION = "Which supplier serves almond region EUROPE?"
_TERMS = ["which", "supplier", "serves", "almond", "region", "europe"]


#: (id, other) both ways: the collapse of edges keeps every pair of nodes, so paths need only the ends of the edges.
_ENDS = "inline(array(named_struct('id', src, 'other', dst), named_struct('id', dst, 'other', src)))"


def _neighbors(c):
    s = build.collapse_edges(c.edges)
    return analyze.neighbors(s), analyze.degree(s)


_IDF = "SELECT term, count(*) FILTER (contains(lower(label), term)) AS df, round(ln(1 + count(*) / (1 + count(*) FILTER (contains(lower(label), term)))), 10) AS idf FROM nodes, (SELECT unnest(" + str(_TERMS) + ") AS term) GROUP BY term"
_SCORED = f"""
WITH i AS ({_IDF}), k AS (SELECT id, label, lower(label) AS k, regexp_replace(lower(label), '[()]+$', '') AS b, lower(source_file) AS s FROM nodes),
x AS (SELECT id, label, round(sum((CASE WHEN k = term OR b = term THEN 1000.0 WHEN starts_with(k, term) OR starts_with(b, term) THEN 100.0 WHEN contains(k, term) THEN 1.0 ELSE 0.0 END + CASE WHEN contains(s, term) THEN 0.5 ELSE 0.0 END) * idf), 6) AS score FROM k, i GROUP BY id, label),
scored AS (SELECT * FROM x WHERE score > 0)
"""


@query("idf", _IDF, "nodes")
def _(c):
    return search.idf(c.nodes, _TERMS)


@query("node_search", _SCORED + "SELECT * FROM scored", "nodes")
def _(c):
    return search.search(c.nodes, QUESTION)


@query("seeds", _SCORED + ", t AS (SELECT * FROM scored ORDER BY score DESC, id DESC LIMIT 3) SELECT * FROM t WHERE score >= 0.2 * (SELECT max(score) FROM t)", "nodes")
def _(c):
    return search.seeds(search.search(c.nodes, QUESTION))


@query("find_node", "SELECT id, CAST(tier AS INTEGER) AS tier FROM (SELECT id, CASE WHEN lower(label) = 'europe' OR lower(id) = 'europe' THEN 0 WHEN starts_with(lower(label), 'europe') OR starts_with(lower(id), 'europe') THEN 1 WHEN contains(lower(label), 'europe') THEN 2 END AS tier FROM nodes) WHERE tier IS NOT NULL", "nodes")
def _(c):
    return search.find_node(c.nodes, "Europe")


@query("resolve_seed", "SELECT min(id) AS id FROM nodes WHERE lower(label) = 'nation_7' HAVING count(*) = 1", "nodes")
def _(c):
    return search.resolve_seed(c.nodes, "Nation_7")


@query("explain_node", """
WITH x AS (SELECT DISTINCT 'out' AS direction, dst AS other, relation FROM edges WHERE src = 'supplier:3' UNION SELECT 'in', src, relation FROM edges WHERE dst = 'supplier:3')
SELECT direction, other, label, relation, degree FROM x JOIN deg ON deg.id = other JOIN nodes n ON n.id = other ORDER BY degree DESC, other, direction, relation LIMIT 20""", "nodes", "deg")
def _(c):
    return search.explain_node(c.edges, _neighbors(c)[1], c.nodes, "supplier:3")


@query("neighbors", "SELECT DISTINCT 'out' AS direction, dst AS other, relation FROM edges WHERE src = 'nation:4' AND contains(relation, 'r') UNION SELECT 'in', src, relation FROM edges WHERE dst = 'nation:4' AND contains(relation, 'r')", "edges")
def _(c):
    return search.node_neighbors(c.edges, "nation:4", "R")


@query("get_community", "SELECT id, label FROM nodes WHERE community = 3", "nodes")
def _(c):
    return c.nodes.filter("community = 3").select("id", "label")


@query("context_filtered_edges", "SELECT src, dst, relation, context, count(*) AS edges FROM edges WHERE context IN ('call', 'field') GROUP BY ALL", "edges")
def _(c):
    contexts = search.context_filters("who invokes it", ["Calls", "members"])
    return search.filter_context(c.edges, contexts).groupBy("src", "dst", "relation", "context").agg(F.count(F.lit(1)).alias("edges"))


_LEVELS = """
WITH hub AS (SELECT greatest(50, d) AS h FROM (SELECT coalesce(degree, 0) AS d, row_number() OVER (ORDER BY coalesce(degree, 0)) - 1 AS i FROM nodes LEFT JOIN deg USING (id)) WHERE i = CAST(floor((SELECT count(*) FROM nodes) * 0.99) AS BIGINT)),
nb AS (SELECT DISTINCT id, other FROM nbr), l0 AS (SELECT unnest(['customer:7', 'part:11']) AS id),
e1 AS (SELECT DISTINCT id AS src, other AS dst FROM nb WHERE id IN (SELECT id FROM l0) AND other NOT IN (SELECT id FROM l0)), v1 AS (SELECT id FROM l0 UNION SELECT dst FROM e1),
e2 AS (SELECT DISTINCT id AS src, other AS dst FROM nb WHERE id IN (SELECT dst FROM e1) AND id NOT IN (SELECT id FROM deg, hub WHERE degree >= h) AND other NOT IN (SELECT id FROM v1)), v2 AS (SELECT id FROM v1 UNION SELECT dst FROM e2)
"""


def _bfs(c):
    nb, deg = _neighbors(c)
    seeds = c.spark.createDataFrame([("customer:7",), ("part:11",)], "id string")
    return traverse.bfs(nb, deg, seeds, 2, traverse.hub_threshold(c.nodes, deg))


@query("bfs_nodes", _LEVELS + "SELECT id, CAST(0 AS INTEGER) AS level FROM l0 UNION SELECT dst, 1 FROM e1 UNION SELECT dst, 2 FROM e2", "nodes", "deg", "nbr")
def _(c):
    return _bfs(c)[0]


@query("bfs_edges", _LEVELS + "SELECT *, CAST(1 AS INTEGER) AS level FROM e1 UNION SELECT *, 2 FROM e2", "nodes", "deg", "nbr")
def _(c):
    return _bfs(c)[1]


@query("affected", """
WITH e AS (SELECT DISTINCT src, dst, relation FROM edges WHERE relation IN ('calls', 'references', 'uses')),
h1 AS (SELECT src AS id, min(relation) AS relation FROM e WHERE dst = 'supplier:2' AND src <> 'supplier:2' GROUP BY src),
h2 AS (SELECT src AS id, min(relation) AS relation FROM e WHERE dst IN (SELECT id FROM h1) AND src NOT IN (SELECT id FROM h1) AND src <> 'supplier:2' GROUP BY src)
SELECT id, CAST(1 AS INTEGER) AS level, relation FROM h1 UNION ALL SELECT id, 2, relation FROM h2""", "edges")
def _(c):
    return traverse.affected(c.edges, "supplier:2")


@query("shortest_path", """
WITH nb AS (SELECT DISTINCT id, other FROM nbr), l0 AS (SELECT 'region:1' AS id),
l1 AS (SELECT other AS id, min(id) AS via FROM nb WHERE id IN (SELECT id FROM l0) AND other NOT IN (SELECT id FROM l0) GROUP BY other), s1 AS (SELECT id FROM l0 UNION SELECT id FROM l1),
l2 AS (SELECT other AS id, min(id) AS via FROM nb WHERE id IN (SELECT id FROM l1) AND other NOT IN (SELECT id FROM s1) GROUP BY other), s2 AS (SELECT id FROM s1 UNION SELECT id FROM l2),
l3 AS (SELECT other AS id, min(id) AS via FROM nb WHERE id IN (SELECT id FROM l2) AND other NOT IN (SELECT id FROM s2) GROUP BY other), s3 AS (SELECT id FROM s2 UNION SELECT id FROM l3),
t AS (SELECT id FROM l3 WHERE id LIKE 'part:%' ORDER BY id LIMIT 1),
p AS (SELECT 3 AS step, id FROM t UNION ALL SELECT 2, via FROM l3 WHERE id IN (SELECT id FROM t) UNION ALL SELECT 1, via FROM l2 WHERE id IN (SELECT via FROM l3 WHERE id IN (SELECT id FROM t)) UNION ALL SELECT 0, 'region:1' FROM t)
SELECT CAST(step AS INTEGER) AS step, id FROM p""", "nbr")
def _(c):
    seen = traverse.levels(c.edges.selectExpr(_ENDS), "region:1", 3)
    target = seen.filter("level = 3 AND id LIKE 'part:%'").agg(F.min("id")).first()[0]
    return traverse.path_back(seen, target)


# every order as an import between the files of two customers, apart by state so that cycles stay listable
_TO = "'m' || (o_orderkey * 13 % (SELECT max(c_custkey) FROM {customer}) + 1) || '_' || o_orderstatus"
_FROM = "'m' || o_custkey || '_' || o_orderstatus"
IMPORTS_NODES = f"SELECT DISTINCT {_FROM} AS id, 'src/' || {_FROM} || '.py' AS source_file FROM {{orders}} UNION SELECT DISTINCT {_TO}, 'src/' || {_TO} || '.py' FROM {{orders}}"
IMPORTS = f"SELECT DISTINCT {_FROM} AS src, {_TO} AS dst, 'imports_from' AS relation, 'src/' || {_FROM} || '.py' AS source_file FROM {{orders}}"


def _sql(text):
    from ..views import for_duckdb

    return for_duckdb(text)


_CYCLES = f"""
WITH e AS (SELECT DISTINCT 'src/' || src || '.py' AS src, 'src/' || dst || '.py' AS dst FROM ({_sql(IMPORTS)})),
p2 AS (SELECT src AS a, dst AS b FROM e WHERE src < dst), p3 AS (SELECT a, b, dst AS c FROM p2 JOIN e ON src = b WHERE dst > a AND dst <> b), p4 AS (SELECT a, b, c, dst AS d FROM p3 JOIN e ON src = c WHERE dst > a AND dst NOT IN (b, c)),
p5 AS (SELECT a, b, c, d, dst AS f FROM p4 JOIN e ON src = d WHERE dst > a AND dst NOT IN (b, c, d)),
cy AS (SELECT CAST(1 AS INTEGER) AS length, src AS cycle FROM e WHERE src = dst UNION ALL SELECT 2, a || ' -> ' || b FROM p2 JOIN e ON src = b AND dst = a
UNION ALL SELECT 3, a || ' -> ' || b || ' -> ' || c FROM p3 JOIN e ON src = c AND dst = a UNION ALL SELECT 4, a || ' -> ' || b || ' -> ' || c || ' -> ' || d FROM p4 JOIN e ON src = d AND dst = a
UNION ALL SELECT 5, a || ' -> ' || b || ' -> ' || c || ' -> ' || d || ' -> ' || f FROM p5 JOIN e ON src = f AND dst = a)"""


@query("import_cycles", _CYCLES + " SELECT * FROM cy")
def _(c):
    return traverse.import_cycles(traverse.import_edges(c.sql(IMPORTS_NODES), c.sql(IMPORTS)))


@query("import_cycle_ranks", _CYCLES + " SELECT CAST(row_number() OVER (ORDER BY length, cycle) AS INTEGER) AS rank, length, cycle FROM cy ORDER BY length, cycle LIMIT 20")
def _(c):
    return traverse.ranked_cycles(traverse.import_cycles(traverse.import_edges(c.sql(IMPORTS_NODES), c.sql(IMPORTS))))


LINKS = "SELECT 'mod' || (p_partkey % 97) || '.name' || p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN 'decl.' || p_partkey ELSE 'mod' || ((p_partkey * 7 % 2000 + 1) % 97) || '.name' || (p_partkey * 7 % 2000 + 1) END AS target FROM {part}"


@query("reexport_closure", f"""
WITH RECURSIVE l AS ({_sql(LINKS)}), r AS (SELECT name, target AS dest, 1 AS hops FROM l UNION ALL SELECT r.name, l.target, hops + 1 FROM r JOIN l ON l.name = r.dest WHERE hops < 2500)
SELECT name, dest AS origin, hops FROM r WHERE dest NOT IN (SELECT name FROM l)""")
def _(c):
    return traverse.reexport_closure(c.sql(LINKS)).withColumn("hops", F.col("hops").cast("int"))


CALLS = "SELECT 'customer:' || o_custkey AS caller, CASE WHEN o_orderkey % 3 = 0 THEN 'Supplier#' || lpad(CAST(o_orderkey % 90 AS VARCHAR(20)), 9, '0') WHEN o_orderkey % 3 = 1 THEN 'NATION_7' ELSE 'no such' END AS callee, o_orderkey % 4 = 1 AS is_member, 'crm/customer_' || (o_custkey % 20) || '.py' AS source_file FROM {orders}"


@query("resolve_calls", f"""
WITH k AS (SELECT id, lower(trim(label)) AS key FROM nodes WHERE file_type = 'code' AND NOT regexp_matches(label, '(?i)\\.(py|js|ts|tsx|jsx|go|rs|java|rb|md|json)$')), u AS (SELECT key, min(id) AS dst FROM k GROUP BY key HAVING count(*) = 1),
h AS (SELECT caller AS src, dst, source_file FROM ({_sql(CALLS)}) JOIN u ON u.key = lower(callee) WHERE NOT is_member AND caller <> dst),
g AS (SELECT src, dst, bool_or(source_file IN ('crm/customer_1.py', 'crm/customer_2.py')) AS known, min(source_file) AS source_file FROM h WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = h.src AND e.dst = h.dst) GROUP BY ALL)
SELECT src, dst, 'calls' AS relation, CASE WHEN known THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence, CASE WHEN known THEN 1.0 ELSE 0.8 END AS confidence_score, source_file FROM g""", "nodes", "edges")
def _(c):
    evidence = c.nodes.select("id", F.explode(F.array(F.lit("crm/customer_1.py"), F.lit("crm/customer_2.py"))).alias("source_file"))
    return resolve.resolve_calls(c.nodes, c.edges, c.sql(CALLS), evidence)


@query("dfs_order")
def _(c):
    nb, deg = _neighbors(c)
    return traverse.depth_first(nb, deg, c.spark.createDataFrame([("region:2",)], "id string"), 2, traverse.hub_threshold(c.nodes, deg))


@query("betweenness")
def _(c):
    return traverse.betweenness(c.edges.selectExpr(_ENDS))


@query("query_graph")
def _(c):
    """Seeds of a question, the nodes within two steps, best connected first."""
    nb, deg = _neighbors(c)
    seeds = search.seeds(search.search(c.nodes, QUESTION)).select("id")
    reached, _ = traverse.bfs(nb, deg, seeds, 2, traverse.hub_threshold(c.nodes, deg))
    return reached.join(c.nodes.select("id", "label"), "id").join(deg, "id").orderBy(F.desc("degree"), "id").select("id", "label", "level", "degree")
