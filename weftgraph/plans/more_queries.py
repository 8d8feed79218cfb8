"""Queries of entity resolution, diagrams, pull requests, detection and change sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import dedup_key
from ..operators import cluster, dedup, detect, diagram, prs
from .base import query

_KEY = "trim(regexp_replace(lower(label), '[\\W_]+', ' ', 'g'))"
_RANK = "CAST(regexp_matches(id, '_c[0-9]+$') AS INT), length(id), id"
_ENTROPY = "list_sum(list_transform(list_distinct(string_split(k, '')), lambda c: -(len(list_filter(string_split(k, ''), lambda x: x = c)) / len(k)) * log2(len(list_filter(string_split(k, ''), lambda x: x = c)) / len(k))))"
_SHINGLES = "list_distinct(CASE WHEN length(replace(k, ' ', '')) < 3 THEN [replace(k, ' ', '')] ELSE list_transform(generate_series(1, length(replace(k, ' ', '')) - 2), lambda i: substr(replace(k, ' ', ''), i, 3)) END)"

# labels with typing mistakes, so that there is something to merge; labels that are mere numbers become words of their own
TYPOS = "SELECT id, CASE WHEN id LIKE 'part:%3' THEN replace(label, 'e', 'ee') WHEN id LIKE 'part:%5' THEN upper(label) WHEN id LIKE 'part:%7' THEN replace(label, 'a', '') WHEN id LIKE 'nation:%' THEN label || ' land' WHEN id LIKE 'part:%' OR id LIKE 'region:%' THEN label WHEN id LIKE '%9' THEN substr(base64(unhex(md5(id))), 1, 15) || ' ' || substr(base64(unhex(md5(id))), 16, 1) ELSE substr(base64(unhex(md5(id))), 1, 16) END AS label, file_type, source_file FROM nodes"


def _typos(c):
    from .build_queries import view

    return view(c, TYPOS)


@query("exact_dups", f"WITH k AS (SELECT id, {_KEY} AS k, source_file FROM ({TYPOS})) SELECT id, winner FROM (SELECT id, first_value(id) OVER (PARTITION BY k, source_file ORDER BY {_RANK}) AS winner FROM k WHERE k <> '') WHERE id <> winner", "nodes")
def _(c):
    return dedup.exact_duplicates(_typos(c))


@query("dedup_by_label", f"WITH k AS (SELECT id, {_KEY} AS k FROM ({TYPOS})) SELECT id, winner FROM (SELECT id, first_value(id) OVER (PARTITION BY k ORDER BY {_RANK}) AS winner FROM k WHERE k <> '') WHERE id <> winner", "nodes")
def _(c):
    return dedup.dedup_by_label(_typos(c))


@query("dedup_winner", f"WITH k AS (SELECT id, {_KEY} AS k FROM ({TYPOS})) SELECT k AS key, arg_min(id, {{'a': CAST(regexp_matches(id, '_c[0-9]+$') AS INT), 'b': length(id), 'c': id}}) AS winner FROM k GROUP BY k", "nodes")
def _(c):
    return dedup.keyed(_typos(c)).groupBy("key").agg(F.min(F.struct(*dedup.winner_rank())).getField("id").alias("winner"))


@query("label_entropy", f"WITH d AS (SELECT DISTINCT {_KEY} AS k FROM nodes) SELECT k AS key, round({_ENTROPY}, 8) AS entropy FROM d", "nodes")
def _(c):
    return c.nodes.select(dedup_key(F.col("label")).alias("key")).distinct().select("key", F.round(dedup.entropy(F.col("key")), 8).alias("entropy"))


# pairs that share no shingle have none of the least overlaps asked for
_PAIRS = f"""d AS (SELECT DISTINCT {_KEY} AS k FROM ({TYPOS})), s AS (SELECT k, {_SHINGLES} AS s, {_ENTROPY} AS h FROM d), x AS (SELECT k, len(s) AS n, h, unnest(s) AS e FROM s),
c AS (SELECT a.k AS a, b.k AS b, any_value(a.h) AS ha, any_value(b.h) AS hb, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM x a JOIN x b ON a.e = b.e AND a.k < b.k GROUP BY a.k, b.k),
p AS (SELECT *, jaro_winkler_similarity(a, b) * 100 AS jw FROM c WHERE j >= 0.5)"""
_VARIANT = "(greatest(length(a), length(b)) < 12 AND regexp_extract(a, '^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$', 1) <> '' AND regexp_extract(a, '^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$', 1) = regexp_extract(b, '^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$', 1) AND regexp_extract(a, '^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$', 2) <> regexp_extract(b, '^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$', 2))"
_ALLOWED = "(greatest(length(a), length(b)) >= 12 OR (jw >= 97 AND length(a) = length(b) AND damerau_levenshtein(a, b) <= 1))"
_FUZZY = f"""WITH {_PAIRS}, f AS (SELECT a, b, round(jw, 4) AS score FROM p WHERE ha >= 2.5 AND hb >= 2.5 AND j >= 0.7 AND jw >= 92
 AND NOT (greatest(length(a), length(b)) < 12 AND regexp_extract(a, '^(.*[a-z])([0-9]+[a-z]*|[a-z]{{2,}})$', 1) <> '' AND regexp_extract(a, '^(.*[a-z])([0-9]+[a-z]*|[a-z]{{2,}})$', 1) = regexp_extract(b, '^(.*[a-z])([0-9]+[a-z]*|[a-z]{{2,}})$', 1) AND regexp_extract(a, '^(.*[a-z])([0-9]+[a-z]*|[a-z]{{2,}})$', 2) <> regexp_extract(b, '^(.*[a-z])([0-9]+[a-z]*|[a-z]{{2,}})$', 2))
 AND (greatest(length(a), length(b)) >= 12 OR (jw >= 97 AND length(a) = length(b) AND damerau_levenshtein(a, b) <= 1)))"""


@query("fuzzy_pairs", _FUZZY + " SELECT * FROM f", "nodes")
def _(c):
    return dedup.fuzzy_pairs(_typos(c))


@query("ambiguous_pairs", f"WITH {_PAIRS} SELECT a, b, round(jw, 4) AS score FROM p WHERE j >= 0.5 AND jw >= 75 AND jw < 92 AND NOT {_VARIANT} AND {_ALLOWED}", "nodes")
def _(c):
    return dedup.ambiguous_pairs(_typos(c), overlapping=0.5)  # as in its SQL; the operator takes all pairs without


_COMPONENTS = f"""{_FUZZY.replace('WITH ', 'WITH RECURSIVE ', 1)}, k AS (SELECT id, {_KEY} AS k, source_file FROM ({TYPOS})),
w AS (SELECT id, first_value(id) OVER (PARTITION BY k, source_file ORDER BY {_RANK}) AS winner FROM k WHERE k <> ''),
fi AS (SELECT k, arg_min(id, {{'a': CAST(regexp_matches(id, '_c[0-9]+$') AS INT), 'b': length(id), 'c': id}}) AS id FROM k GROUP BY k),
l AS (SELECT id AS a, winner AS b FROM w WHERE id <> winner UNION SELECT x.id, y.id FROM f JOIN fi x ON x.k = f.a JOIN fi y ON y.k = f.b),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
m AS (SELECT x AS id, arg_min(y, {{'a': CAST(regexp_matches(y, '_c[0-9]+$') AS INT), 'b': length(y), 'c': y}}) AS winner FROM r GROUP BY x)"""


@query("dedup_components", _COMPONENTS + " SELECT id, winner FROM m WHERE id <> winner", "nodes")
def _(c):
    return dedup.resolve_entities(_typos(c))


@query("dedup_rewrite", _COMPONENTS + ", z AS (SELECT coalesce(a.winner, src) AS src, coalesce(b.winner, dst) AS dst, relation FROM edges LEFT JOIN m a ON a.id = src LEFT JOIN m b ON b.id = dst) SELECT src, dst, relation, count(*) AS edges FROM z WHERE src <> dst GROUP BY ALL", "nodes", "edges")
def _(c):
    return dedup.rewrite_edges(c.edges, dedup.resolve_entities(_typos(c))).groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("edges"))


# ---- diagrams

KINDS = "SELECT id, CASE WHEN id LIKE 'customer:%1' THEN 'useAccount' WHEN id LIKE 'customer:%2' THEN 'test_balance' WHEN id LIKE 'customer:%3' THEN 'balance_api' WHEN id LIKE 'customer:%4' THEN 'stream rows' WHEN id LIKE 'customer:%5' THEN 'main.py' WHEN id LIKE 'customer:%6' THEN 'click here' WHEN id LIKE 'customer:%7' THEN 'load()' ELSE label END AS label, file_type, CASE WHEN id LIKE 'supplier:%1' THEN 'ui/App.tsx' ELSE source_file END AS source_file, community FROM nodes"


@query("node_kind", f"""
SELECT id, CASE WHEN file_type IN ('rationale', 'document') THEN 'concept' WHEN contains(lower(source_file), 'test') OR starts_with(lower(label), 'test_') OR contains(lower(source_file), 'spec') THEN 'test'
 WHEN regexp_matches(lower(label), 'endpoint|router|api|route') THEN 'api' WHEN regexp_matches(lower(label), 'cli|command|click|typer') THEN 'entry' WHEN regexp_matches(lower(label), 'async|await|stream|sse') THEN 'async'
 WHEN regexp_matches(lower(label), 'component|props|hook|store') OR regexp_matches(label, '^use[A-Z_\\-]') OR regexp_matches(lower(source_file), '\\.(tsx|jsx|vue|svelte)$') THEN 'ui'
 WHEN regexp_matches(label, '^[A-Z]') AND NOT ends_with(label, '()') THEN 'klass' WHEN regexp_matches(label, '\\.(py|ts|tsx|js|jsx|go|rs|java|kt|rb|php|cs|swift|vue|svelte)$') THEN 'module' ELSE 'function' END AS kind FROM ({KINDS})""", "nodes")
def _(c):
    from .build_queries import view

    return view(c, KINDS).select("id", diagram.node_kind().alias("kind"))


_SCORE = "coalesce(confidence_score, 1.0) + CASE confidence WHEN 'EXTRACTED' THEN 2.0 ELSE 0.0 END + CASE WHEN relation IN ('calls', 'uses', 'method') THEN 1.0 WHEN relation IN ('imports', 'imports_from') THEN 0.6 WHEN relation = 'contains' THEN -0.2 WHEN relation = 'rationale_for' THEN -0.6 ELSE 0.0 END"


@query("edge_scores", f"SELECT relation, confidence, round({_SCORE}, 6) AS score, count(*) AS edges FROM edges GROUP BY ALL", "edges")
def _(c):
    return c.edges.groupBy("relation", "confidence", F.round(diagram.edge_score(), 6).alias("score")).agg(F.count(F.lit(1)).alias("edges"))


@query("participation", f"SELECT id, round(sum(s), 6) AS score FROM (SELECT src AS id, {_SCORE} AS s FROM edges UNION ALL SELECT dst, {_SCORE} FROM edges) GROUP BY id", "edges")
def _(c):
    return diagram.participation(c.edges)


# communities named after the words that sections look for
WORDED = "SELECT id, CASE community WHEN 0 THEN 'python parser ' || label WHEN 1 THEN 'merge graph' WHEN 2 THEN 'search api ' || label WHEN 3 THEN 'test' ELSE label END AS label, source_file, file_type, community FROM nodes"
_RE = {name: "(" + "|".join(words.split()) + ")" for name, words in diagram.SECTIONS.items()}


@query("sections", f"""
WITH t AS (SELECT community, string_agg(t, ' ' ORDER BY id) AS t FROM (SELECT community, id, lower(label || ' ' || source_file || ' ' || file_type) AS t, row_number() OVER (PARTITION BY community ORDER BY id) AS r FROM ({WORDED})) WHERE r <= 80 GROUP BY community),
w AS (SELECT community, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS x FROM t),
s AS (SELECT community, name, i, count(*) AS hits FROM w JOIN (SELECT unnest({[x for words in diagram.SECTIONS.values() for x in words.split()]}) AS x, unnest({[n for n, words in diagram.SECTIONS.items() for _ in words.split()]}) AS name, unnest({[i for i, words in enumerate(diagram.SECTIONS.values()) for _ in words.split()]}) AS i) USING (x) GROUP BY ALL),
b AS (SELECT community, arg_min(name, {{'m': -hits, 'i': i}}) AS name, max(hits) AS hits FROM s GROUP BY community)
SELECT t.community, CASE WHEN coalesce(hits, 0) >= 2 THEN name ELSE 'other' END AS section, CAST(coalesce(hits, 0) AS BIGINT) AS hits FROM t LEFT JOIN b USING (community)""", "nodes")
def _(c):
    from .build_queries import view

    return diagram.sections(view(c, WORDED))


def _classed(c):
    section = c.nodes.filter("community < 8").select("id", F.concat(F.lit("s"), (F.col("community") % 4).cast("string")).alias("section"))
    return diagram.edge_classes(c.edges, section)


_CLASSED = "WITH n AS (SELECT id, 's' || (community % 4) AS section FROM nodes WHERE community < 8), x AS (SELECT e.*, a.section AS src_section, b.section AS dst_section, CASE WHEN a.section IS NULL OR b.section IS NULL THEN 'orphan' WHEN a.section = b.section THEN 'intra' ELSE 'inter' END AS class FROM edges e LEFT JOIN n a ON a.id = src LEFT JOIN n b ON b.id = dst)"


@query("edge_classes", _CLASSED + " SELECT class, relation, count(*) AS edges FROM x GROUP BY ALL", "nodes", "edges")
def _(c):
    return _classed(c).groupBy("class", "relation").agg(F.count(F.lit(1)).alias("edges"))


@query("section_flow", _CLASSED + " SELECT src_section, dst_section, count(*) AS edges FROM x WHERE class = 'inter' AND (confidence = 'EXTRACTED' OR (confidence = 'INFERRED' AND coalesce(confidence_score, 1.0) >= 0.85)) GROUP BY ALL", "nodes", "edges")
def _(c):
    return diagram.section_flow(_classed(c))


# ---- pull requests

TODAY = "1998-08-05"


@query("pr_status", f"""
SELECT status, count(*) AS prs FROM (SELECT CASE WHEN base_branch <> 'main' THEN 'WRONG-BASE' WHEN ci_status = 'FAILURE' THEN 'CI-FAIL' WHEN review_decision = 'CHANGES_REQUESTED' THEN 'CHANGES-REQ' WHEN is_draft THEN 'DRAFT'
 WHEN date_diff('day', updated_on, DATE '{TODAY}') >= 14 THEN 'STALE' WHEN review_decision = 'APPROVED' THEN 'APPROVED' WHEN ci_status = 'PENDING' THEN 'PENDING' ELSE 'READY' END AS status FROM prs) GROUP BY status""", "prs")
def _(c):
    return c.prs.groupBy(prs.status("main", TODAY).alias("status")).agg(F.count(F.lit(1)).alias("prs"))


CHANGED = "SELECT l_orderkey AS number, CASE l_linenumber % 3 WHEN 0 THEN 'part_' || (l_partkey % 50) || '.pdf' WHEN 1 THEN 'repo/catalog/part_' || (l_partkey % 50) || '.pdf' ELSE 'other/part_' || (l_partkey % 50) || '.pdf' END AS file FROM {lineitem}"


@query("pr_impact", """
WITH ch AS (SELECT DISTINCT * FROM (""" + CHANGED.replace("{lineitem}", "lineitem") + """)), f AS (SELECT source_file, count(*) AS n FROM nodes WHERE source_file <> '' GROUP BY 1),
h AS (SELECT DISTINCT number, source_file, n FROM ch JOIN f ON source_file = file OR ends_with(source_file, '/' || file) OR ends_with(file, '/' || source_file))
SELECT number, (SELECT string_agg(CAST(community AS VARCHAR), ',' ORDER BY community) FROM (SELECT DISTINCT community FROM nodes WHERE source_file IN (SELECT h2.source_file FROM h h2 WHERE h2.number = h.number))) AS communities, CAST(sum(n) AS BIGINT) AS nodes FROM h GROUP BY number""", "nodes")
def _(c):
    return prs.impact(c.sql(CHANGED), c.nodes)


@query("pr_conflicts", "SELECT community, count(*) AS prs FROM (SELECT DISTINCT l_orderkey, community FROM lineitem JOIN nodes ON id = 'part:' || l_partkey) GROUP BY community HAVING count(*) > 1", "nodes")
def _(c):
    touched = c.table("lineitem").select(F.col("l_orderkey").alias("number"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id")).join(c.nodes.select("id", "community"), "id").select("number", "community")
    return prs.conflicts(touched)


# ---- detection

_HITS = " + ".join(f"CAST(regexp_matches(h, '{rx}') AS INT)" for rx in detect.PAPER_SIGNALS)
SIGNED = "SELECT path, CASE WHEN path LIKE '%7.md' THEN 'Abstract: we propose, see [12] and doi: 10 in the Journal. ' || content WHEN path LIKE '%docs/src1/%' AND path NOT LIKE '%.%' THEN '#!/usr/bin/env python3' || chr(10) || content ELSE content END AS content FROM {files}"


def _signed(c):
    return c.spark.sql(SIGNED, files=c.files)


@query("paper_signals", f"SELECT path, {_HITS} AS signals FROM (SELECT path, substr(content, 1, 3000) AS h FROM ({SIGNED.replace('{files}', 'files')}))", "files")
def _(c):
    return _signed(c).select("path", detect.paper_signals(F.col("content")).alias("signals"))


@query("classify_files", f"""
WITH x AS (SELECT path, content, lower(regexp_extract(path, '[^/]+\\.([^./]+)$', 1)) AS s, substr(content, 1, 3000) AS h FROM ({SIGNED.replace('{{files}}', 'files').replace('{files}', 'files')}))
SELECT path, CASE WHEN s = '' THEN CASE WHEN starts_with(content, '#!/usr/bin/env python3') THEN 'code' END WHEN s = 'py' THEN 'code' WHEN s = 'pdf' THEN 'paper' WHEN s = 'png' THEN 'image'
 WHEN s IN ('md', 'txt', 'html') THEN CASE WHEN {_HITS} >= 3 THEN 'paper' ELSE 'document' END WHEN s = 'mp4' THEN 'video' END AS kind FROM x""", "files")
def _(c):
    return _signed(c).select("path", detect.classify(F.col("path"), F.col("content")).alias("kind"))


_TRIM = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query("word_count_by_source", f"SELECT source, CAST(sum(CASE WHEN {_TRIM} = '' THEN 0 ELSE len(regexp_split_to_array({_TRIM}, '\\s+')) END) AS BIGINT) AS words FROM documents GROUP BY source")
def _(c):
    return c.table("documents").groupBy("source").agg(F.sum(detect.word_count(F.col("text"))).alias("words"))


@query("url_type", """
SELECT page_id, CASE WHEN contains(l, 'twitter.com') OR contains(l, 'x.com') THEN 'tweet' WHEN contains(l, 'arxiv.org') THEN 'arxiv' WHEN contains(l, 'github.com') THEN 'github' WHEN contains(l, 'youtube.com') OR contains(l, 'youtu.be') THEN 'youtube'
 WHEN ends_with(p, '.pdf') THEN 'pdf' WHEN regexp_matches(p, '\\.(png|jpg|jpeg|webp|gif)$') THEN 'image' ELSE 'webpage' END AS kind FROM (SELECT page_id, lower(url) AS l, regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS p FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://arxiv.org/abs/' || page_id WHEN 2 THEN 'https://site.org/a.PDF?x=' || page_id WHEN 3 THEN 'https://github.com/a/' || page_id WHEN 4 THEN 'http://site.org/i.png#' || page_id ELSE 'https://youtu.be/' || page_id END AS url FROM pages))""")
def _(c):
    u = F.expr("CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://arxiv.org/abs/' || page_id WHEN 2 THEN 'https://site.org/a.PDF?x=' || page_id WHEN 3 THEN 'https://github.com/a/' || page_id WHEN 4 THEN 'http://site.org/i.png#' || page_id ELSE 'https://youtu.be/' || page_id END")
    return c.table("pages").select("page_id", detect.url_type(u).alias("kind"))


@query("html_text", r"""
SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 8000) AS text FROM pages""")
def _(c):
    return c.table("pages").select("page_id", detect.html_text(F.col("html")).alias("text"))


@query("content_hash", "SELECT path, sha256(content || chr(0) || lower(path)) AS hash FROM files", "files")
def _(c):
    return c.files.select("path", detect.content_hash(F.col("path"), F.col("content")).alias("hash"))


@query("cache_split", "WITH h AS (SELECT path, md5(content) AS hash FROM files) SELECT path, hash IN (SELECT hash FROM h WHERE length(path) % 2 = 0) AS hit FROM h", "files")
def _(c):
    h = c.files.select("path", F.md5("content").alias("hash"))
    return detect.cache_split(h, h.filter(F.length("path") % 2 == 0))


@query("incremental_diff", """
WITH n AS (SELECT path, CAST(length(path) AS DOUBLE) AS mtime, md5(content) AS hash FROM files WHERE path NOT LIKE '%9.%'),
m AS (SELECT path, CASE WHEN path LIKE '%.md' THEN CAST(length(path) AS DOUBLE) ELSE 0.0 END AS mtime, CASE WHEN path LIKE '%.py' THEN NULL WHEN path LIKE '%.html' THEN 'old' ELSE md5(content) END AS hash FROM files WHERE path NOT LIKE '%8.%')
SELECT coalesce(n.path, m.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN m.path IS NULL THEN 'new' WHEN m.hash IS NULL THEN 'changed' WHEN n.mtime = m.mtime THEN 'unchanged' WHEN n.hash = m.hash THEN 'unchanged' ELSE 'changed' END AS state FROM n FULL JOIN m ON n.path = m.path""", "files")
def _(c):
    f = c.files.select("path", F.length("path").cast("double").alias("mtime"), F.md5("content").alias("hash"))
    m = f.filter("path NOT LIKE '%8.%'").withColumn("mtime", F.expr("CASE WHEN path LIKE '%.md' THEN mtime ELSE 0.0D END")).withColumn("hash", F.expr("CASE WHEN path LIKE '%.py' THEN NULL WHEN path LIKE '%.html' THEN 'old' ELSE hash END"))
    return detect.incremental_diff(f.filter("path NOT LIKE '%9.%'"), m)


@query("dir_rollup", "WITH p AS (SELECT path, string_split(path, '/') AS s FROM files) SELECT dir, count(*) AS files FROM (SELECT unnest(list_transform(generate_series(0, len(s) - 1), lambda i: CASE WHEN i = 0 THEN '.' ELSE array_to_string(s[1:i], '/') END)) AS dir FROM p) GROUP BY dir", "files")
def _(c):
    return detect.dir_rollup(c.files)


@query("pack_chunks")
def _(c):
    return detect.pack_chunks(c.files, 20000)


@query("sensitive_files", "SELECT path, contains(path, 'secrets/') OR ends_with(path, '.pem') OR regexp_matches(path, 'token') AS sensitive FROM (SELECT path || CASE length(content) % 4 WHEN 0 THEN '.pem' WHEN 1 THEN '' WHEN 2 THEN '/secrets/a.txt' ELSE '/api_token.txt' END AS path FROM files)", "files")
def _(c):
    p = F.expr("path || CASE length(content) % 4 WHEN 0 THEN '.pem' WHEN 1 THEN '' WHEN 2 THEN '/secrets/a.txt' ELSE '/api_token.txt' END")
    return c.files.select(p.alias("path")).select("path", detect.is_sensitive(F.col("path")).alias("sensitive"))


# ---- change sessions

@query("debounce_sessions", """
WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM s)
SELECT user_id, min(ts) AS started, count(*) AS changes, count(DISTINCT event_type) AS kinds FROM g GROUP BY user_id, n""")
def _(c):
    from ..streaming.watch import debounce

    return debounce(c.table("events"), "user_id", "ts", "event_type", "3 hours").select("user_id", "started", "changes", F.size("paths").cast("long").alias("kinds"))


# ---- communities

@query("communities")
def _(c):
    return cluster.with_isolates(cluster.communities(_simple(c)), c.nodes)


@query("community_remap")
def _(c):
    now = cluster.with_isolates(cluster.communities(_simple(c)), c.nodes)
    return cluster.remap(now, c.nodes.select("id", "community"))


def _simple(c):
    """The pairs of nodes that the collapse of edges keeps, which are all."""
    return c.edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()


# ---- sources

INDEX = """
SELECT to_json(named_struct('documents', collect_list(d))) AS json FROM (
 SELECT named_struct('relative_path', 'nation/' || n_nationkey || '.py', 'symbols', array(named_struct('symbol', n_name, 'relationships', array(
   named_struct('symbol', r_name, 'is_implementation', n_nationkey % 2 = 0, 'is_reference', true), named_struct('symbol', 'ext' || (n_nationkey % 3), 'is_implementation', false, 'is_reference', n_nationkey % 5 = 0))))) AS d
 FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
 UNION ALL SELECT named_struct('relative_path', 'region/' || r_regionkey || '.py', 'symbols', array(named_struct('symbol', r_name, 'relationships', CAST(array() AS ARRAY<STRUCT<symbol: STRING, is_implementation: BOOLEAN, is_reference: BOOLEAN>>)))) FROM {region})
"""


@query("scip_edges", """
SELECT 'scip_' || substr(sha1('nation/' || n_nationkey || '.py|' || n_name), 1, 16) AS src, 'scip_' || substr(sha1('region/' || r_regionkey || '.py|' || r_name), 1, 16) AS dst, CASE WHEN n_nationkey % 2 = 0 THEN 'scip_impl' ELSE 'scip_ref' END AS relation FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'scip_' || substr(sha1('nation/' || n_nationkey || '.py|' || n_name), 1, 16), 'scip_ext_' || substr(sha1('ext' || (n_nationkey % 3)), 1, 16), 'scip_ref' FROM nation WHERE n_nationkey % 5 = 0""")
def _(c):
    from ..sources.graphs import symbol_index

    return symbol_index(c.sql(INDEX))[1].select("src", "dst", "relation")


@query("extract_files")
def _(c):
    """Rows that the extractors find in the files, by kind."""
    from ..sources.extract import extract

    return extract(c.files).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))


@query("community_wiki")
def _(c):
    """The article of each community."""
    from ..operators import build
    from ..sinks.notes import community_articles

    return community_articles(c.nodes, build.collapse_edges(c.edges))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def _(c):
    from ..streaming.watch import event_counts

    return event_counts(c.table("events"))
