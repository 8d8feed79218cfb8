"""Scans, resolutions, betweenness of edges, queues and guards on small inputs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tests.test_catalog import DIR, needs_tables, norm
from weftgraph.operators import analyze, dedup, detect, prs, resolve, traverse
from weftgraph.plans.catalog import QUERIES, SQL
from weftgraph.streaming import watch

NEW = ["noise_files", "ignored_files", "allowed_files", "corpus_scan", "corpus_verdict", "java_imports", "shell_sources", "star_reexports", "pr_order", "import_cycles", "import_cycle_ranks", "suggested_questions", "fuzzy_pairs", "ambiguous_pairs", "dedup_components"]


@needs_tables
@pytest.mark.parametrize("name", NEW)
def test_like_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{t}'")
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert norm(tuple(r) for r in df.select(*cols).collect()) == norm(want)
    assert want


def test_lines_of_ignore_files():
    lines = ["# all", "", "  *.log   ", "a#b.py", "c.py # why", "\\#real", "!keep.log", "/top", "sp\\ ", "!"]
    assert detect.parse_ignore(lines, "sub") == [("*.log", False, "sub"), ("a#b.py", False, "sub"), ("c.py", False, "sub"), ("#real", False, "sub"), ("keep.log", True, "sub"), ("/top", False, "sub"), ("sp\\ ", False, "sub")]


def test_rules_of_nested_folders(spark):
    rules = [*detect.parse_ignore(["/gen", "tmp*"], "a"), *detect.parse_ignore(["*.log", "!a/keep.log", "x/*.md"])]
    paths = ["a/gen/f.py", "gen/f.py", "a/tmp1/f", "b/z.log", "a/keep.log", "x/y/z.md", "q/x/z.md", "fine.py"]
    got = {r["path"]: r["ignored"] for r in detect.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}
    assert [got[p] for p in paths] == [True, False, True, True, False, True, False, False]


def test_scan_of_a_small_corpus(spark):
    files = [("a.py", "x y"), ("venv/b.py", "z"), (".hidden/c.py", "one"), (".other/d.py", "two"), ("e.xyz", "no"), ("f.md", None), ("id_rsa", "k"), ("g/poetry.lock", "l")]
    df = spark.createDataFrame(files, "path string, content string")
    got = {tuple(r) for r in detect.scan(df, [], detect.parse_ignore([".hidden"])).collect()}
    assert got == {("a.py", "code", 2), (".hidden/c.py", "code", 1), ("f.md", "document", 0)}
    assert tuple(detect.verdict(detect.scan(df.limit(0), [])).first()) == (0, 0, False, False)


def test_paths_are_joined(spark):
    rows = [("a/b", "../c.sh", "a/c.sh"), ("a", "./x/../y", "a/y"), ("", "q", "q"), ("a", "/abs/./z", "/abs/z"), ("a", "../../z", "z")]
    for folder, path, want in rows:
        got = spark.createDataFrame([(folder, path)], "f string, p string").select(resolve.joined_path(F.col("f"), F.col("p"))).first()[0]
        assert got.lstrip("/") == want.lstrip("/"), (folder, path, got)


def brute_edges(adj):
    """Edge betweenness over all ordered pairs, by listing shortest paths."""
    score = {}
    for s in adj:
        for t in adj:
            found, level = [], [[s]]
            while level and not found and s != t:
                found = [p for p in level if p[-1] == t]
                level = [] if found else [[*p, n] for p in level for n in adj[p[-1]] if n not in p]
            for p in found:
                for e in zip(p, p[1:], strict=False):
                    k = tuple(sorted(e))
                    score[k] = score.get(k, 0) + 1 / len(found)
    return {k: round(v, 6) for k, v in score.items()}


def test_edge_betweenness_like_brute_force(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "e"), ("x", "y")]
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    near = spark.createDataFrame([(a, b) for a in adj for b in adj[a]], "id string, other string")
    got = {(r["lo"], r["hi"]): r["score"] for r in traverse.edge_betweenness(near, near.select("id").distinct()).collect()}
    assert got == pytest.approx(brute_edges(adj))
    simple = spark.createDataFrame([(min(p), max(p), *p, "calls", "EXTRACTED") for p in pairs], "lo string, hi string, src string, dst string, relation string, confidence string")
    assert [(r["lo"], r["hi"]) for r in analyze.bridging_edges(simple, 1).collect()] == [("d", "e")]


def test_one_repository_at_a_time(spark):
    one = spark.createDataFrame([("a", "r1"), ("b", "r1"), ("c", None), ("d", "")], "id string, repo string")
    dedup.repo_guard(one)
    with pytest.raises(ValueError, match="r1, r2"):
        dedup.repo_guard(one.union(spark.createDataFrame([("e", "r2")], one.schema)))


def test_bonus_of_a_community(spark):
    df = spark.createDataFrame([("abcdefghijkl", "abcdefghijkm", True), ("abcdefghijkl", "abcdefghijkm", False), ("abc", "abd", True)], "a string, b string, same boolean")
    assert [r[0] for r in df.select(dedup.boosted(F.lit(80.0), F.col("a"), F.col("b"), F.col("same"))).collect()] == [85.0, 80.0, 80.0]


def test_snapshot_of_requests(spark, tmp_path):
    items = [
        {"number": 1, "title": "t", "headRefName": "h", "baseRefName": "main", "author": {"login": "u"}, "isDraft": True, "reviewDecision": "APPROVED", "statusCheckRollup": [{"conclusion": "SUCCESS", "status": "COMPLETED"}], "updatedAt": "2024-01-02T03:04:05Z"},
        {"number": 2, "title": "t", "headRefName": "h", "baseRefName": "dev", "updatedAt": "2024-01-01T00:00:00Z", "statusCheckRollup": [{"conclusion": "FAILURE", "status": "COMPLETED"}]},
        {"number": 3, "title": "t", "headRefName": "h", "baseRefName": "main", "updatedAt": "2024-01-03T00:00:00Z"},
    ]
    (tmp_path / "prs.json").write_text(json.dumps(items))
    got = prs.read_requests(spark, str(tmp_path / "prs.json"))
    assert [tuple(r) for r in got.orderBy("number").select("number", "author", "is_draft", "review_decision", "ci_status").collect()] == [(1, "u", True, "APPROVED", "SUCCESS"), (2, "?", False, "", "FAILURE"), (3, "?", False, "", "NONE")]
    assert [r["number"] for r in prs.in_order(got, "main", "2024-01-04").collect()] == [2, 1, 3]


def test_queue_is_drained_once(spark, tmp_path):
    make = lambda *paths: spark.createDataFrame(list(enumerate(paths)), "ord long, path string")
    watch.queue_pending(make("b.py", "a.py", " "), str(tmp_path))
    watch.queue_pending(make("c.py", "b.py"), str(tmp_path))
    assert [r["path"] for r in watch.drain_pending(spark, str(tmp_path)).orderBy("ord").collect()] == ["b.py", "a.py", "c.py"]
    assert watch.drain_pending(spark, str(tmp_path)).count() == 0
