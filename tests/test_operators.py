"""Operators on small graphs built by hand, with rows worked out from the rules."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import keys
from weftgraph.operators import analyze, build, cluster, dedup, detect, diagram, prs, resolve, search, traverse

EDGE = "src string, dst string, relation string, confidence string, confidence_score double, context string, weight double, source_file string, ord long"
NODE = "id string, label string, file_type string, source_file string, community int"


@pytest.fixture
def edges(spark):
    def make(*rows):
        full = []
        for i, r in enumerate(rows):
            s, d, rel, conf, *rest = (*r, "calls", "EXTRACTED")[:4] if len(r) < 4 else r
            full.append((s, d, rel, conf, None, rest[0] if rest else None, 1.0, "a.py", i))
        return spark.createDataFrame(full, EDGE)

    return make


@pytest.fixture
def nodes(spark):
    def make(*rows):
        return spark.createDataFrame([(r[0], r[1] if len(r) > 1 else r[0], r[2] if len(r) > 2 else "code", r[3] if len(r) > 3 else f"{r[0]}.py", r[4] if len(r) > 4 else 0) for r in rows], NODE)

    return make


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_collapse_keeps_the_first_direction(edges):
    e = edges(("z", "a", "calls", "EXTRACTED"), ("a", "z", "calls", "EXTRACTED"))
    assert rows(build.collapse_edges(e), "src", "dst", "relation") == [("a", "z", "calls")]


def fold(edge_rows):
    """The sequential rule: edges in order of (src, dst, relation), later over earlier, a reverse
    edge skipped while the pair holds its relation the other way round."""
    state = {}
    for s, d, rel, n in sorted(edge_rows):
        pair = tuple(sorted((s, d)))
        now = state.get(pair)
        if now and now[2] == rel and (now[0], now[1]) == (d, s) and s != d:
            continue
        state[pair] = (s, d, rel, n)
    return sorted(state.values())


def test_collapse_like_the_sequential_rule(spark):
    import random

    r = random.Random(7)
    raw = [(r.choice("abcd"), r.choice("abcd"), r.choice(["calls", "uses", "about"]), i) for i in range(60)]
    df = spark.createDataFrame([(s, d, rel, "EXTRACTED", None, None, float(n), "f", n) for s, d, rel, n in raw], EDGE)
    got = sorted((x["src"], x["dst"], x["relation"], int(x["weight"])) for x in build.collapse_edges(df).collect())
    assert got == fold(raw)


def test_degree_counts_a_loop_twice(edges):
    s = build.collapse_edges(edges(("a", "b"), ("b", "a"), ("a", "a")))
    assert rows(analyze.degree(s)) == [("a", 3), ("b", 1)]


def test_god_nodes_skip_files_and_concepts(nodes, edges):
    n = nodes(("f", "f.py"), ("x", "X"), ("idea", "Idea", "concept", ""), ("m", ".run()"), ("k", "Name", "code", "pkg.json"))
    e = edges(*[(a, b) for a in ("f", "idea", "m", "k") for b in ("x",)], ("f", "m"))
    got = analyze.god_nodes(analyze.rich_nodes(n, build.collapse_edges(e))).collect()
    assert [(r["id"], r["degree"]) for r in got] == [("x", 4)]


def test_validation_and_dangling(nodes, edges):
    n = nodes(("a",), ("b", None), ("c", "c", "table"))
    e = edges(("a", "b"), ("a", "gone"), (None, "a"), ("a", "c", "calls", "MAYBE"))
    assert rows(build.validation_errors(n, e)) == [("edge_confidence", "a->c", "MAYBE"), ("edge_dangling", "a->gone", "dst"), ("edge_missing", "?->a", "src"), ("node_file_type", "c", "table"), ("node_missing", "b", "label")]
    assert build.prune_dangling(n, e).count() == 2


def test_phantom_calls(nodes, edges):
    n = nodes(("p", "p", "code", "a.py"), ("g", "g", "code", "a.go"), ("u", "u", "code", "a.weird"), ("z", "z", "code", None))
    e = edges(("p", "g", "calls", "INFERRED"), ("p", "g", "uses", "INFERRED"), ("p", "u", "calls", "INFERRED"), ("p", "z", "calls", "INFERRED"), ("p", "g", "calls", "EXTRACTED"))
    assert rows(build.drop_phantom_calls(n, e), "dst", "relation", "confidence") == [("g", "calls", "EXTRACTED"), ("g", "uses", "INFERRED"), ("z", "calls", "INFERRED")]


def test_diff_of_a_graph_with_itself_is_empty(nodes, edges):
    n, e = nodes(("a",), ("b",)), edges(("a", "b"))
    assert build.diff_nodes(n, n).count() == 0 and build.diff_edges(e, e).count() == 0 and build.same_topology(e, e)
    assert rows(build.diff_edges(e, edges(("b", "a"), ("a", "a")))) == [("added", "a", "a", "calls")]


def test_upsert_overlays_and_keeps(spark):
    s = "id string, label string, file_type string, ord long"
    old, new = spark.createDataFrame([("a", "old", "code", 0), ("b", "b", "code", 1)], s), spark.createDataFrame([("a", "new", None, 0)], s)
    assert rows(build.upsert_nodes(old, new), "id", "label", "file_type") == [("a", "new", "code"), ("b", "b", "code")]
    assert rows(build.upsert_nodes(old, new, "first"), "id", "label") == [("a", "old"), ("b", "b")]


def test_replace_files_and_hyperedges(spark, nodes, edges):
    n, e = nodes(("a",), ("b",), ("c",)), edges(("a", "b"), ("b", "c"))
    evicted = spark.createDataFrame([("c.py",)], "source_file string")
    out_n, out_e = build.replace_files(n, e, nodes(("a2", "a2", "code", "a.py")), edges(("a2", "b")), evicted)
    assert rows(out_n, "id") == [("a2",), ("b",)] and rows(out_e, "src", "dst") == [("a2", "b")]
    h = "id string, label string"
    assert rows(build.attach_hyperedges(spark.createDataFrame([("h", "1")], h), spark.createDataFrame([("h", "2"), (None, "3"), ("i", "4")], h))) == [("h", "1"), ("i", "4")]


def test_search_seeds_and_terms(spark, nodes):
    n = nodes(*[(f"e{i}", f"error_handler_{i}") for i in range(20)], ("s", "FooBarService"), ("c", "ServiceClient()"))
    got = search.search(n, "FooBarService error")
    assert got.orderBy(F.desc("score")).first()["id"] == "s"
    assert [r["id"] for r in search.seeds(got).collect()] == ["s"]
    assert search.query_terms("the of a! Zürich x1 中文字") == ["the", "zürich", "x1", "中文", "文字", "中文字"]
    assert search.context_filters("which params are returned?") == ["parameter_type", "return_type"]
    assert search.context_filters("x", ["Annotations", "calls", "call"]) == ["attribute", "call"]
    assert rows(search.find_node(n, "serviceclient")) == [("c", 0)]
    assert search.search(n, "of").count() == 0


def test_resolve_seed_ladder(nodes):
    n = nodes(("one", "Twin"), ("two", "Twin"), ("three", "Only label"))
    pick = lambda t: [r[0] for r in search.resolve_seed(n, t).collect()]
    assert pick("one") == ["one"] and pick("only LABEL") == ["three"] and pick("two.py") == ["two"] and pick("label") == ["three"] and pick("twin") == [] and pick("zzz") == []


def test_bfs_edges_hubs_and_reach(spark, edges):
    s = build.collapse_edges(edges(("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e")))
    nb, deg = analyze.neighbors(s), analyze.degree(s)
    seeds = spark.createDataFrame([("a",)], "id string")
    got, via = traverse.bfs(nb, deg, seeds, 2, 50)
    assert rows(got) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(via, "src", "dst") == [("a", "b"), ("a", "c"), ("c", "d")]  # none within a level
    cut, _ = traverse.bfs(nb, deg, seeds, 3, 3)
    assert rows(cut, "id") == [("a",), ("b",), ("c",)]
    comp = {r["node"]: r["root"] for r in traverse.components(s.select(F.col("lo").alias("a"), F.col("hi").alias("b"))).collect()}
    assert set(comp.values()) == {"a"} and {r["id"] for r in got.collect()} <= set(comp)
    assert [r["id"] for r in traverse.shortest_path(nb, "a", "e").orderBy("step").collect()] == ["a", "c", "d", "e"]
    assert traverse.shortest_path(nb, "a", "nowhere").count() == 0 and traverse.shortest_path(nb, "a", "e", 2).count() == 0
    order = [r["id"] for r in traverse.depth_first(nb, deg, seeds, 3, 50).orderBy("position").collect()]
    assert order == ["a", "c", "d", "e", "b"]


def test_affected_walks_backwards(edges):
    e = edges(("caller", "target"), ("barrel", "target", "re_exports", "EXTRACTED"), ("consumer", "barrel", "imports", "EXTRACTED"), ("far", "consumer"), ("doc", "target", "mentions", "EXTRACTED"))
    assert rows(traverse.affected(e, "target")) == [("barrel", 1, "re_exports"), ("caller", 1, "calls"), ("consumer", 2, "imports")]


def test_import_cycles(spark):
    f = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d"), ("c", "x")], "src string, dst string")
    assert rows(traverse.import_cycles(f)) == [(1, "d"), (2, "a -> b"), (3, "a -> b -> c")]


def test_closure_guards_cycles(spark):
    f = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "decl"), ("x", "y"), ("y", "x"), ("z", "x")], "name string, target string")
    assert rows(traverse.reexport_closure(f)) == [("a", "decl", 3), ("b", "decl", 2), ("c", "decl", 1)]


def test_betweenness_of_a_path(edges):
    nb = analyze.neighbors(build.collapse_edges(edges(("a", "b"), ("b", "c"), ("c", "d"))))
    got = dict(rows(traverse.betweenness(nb, nb.select("id").distinct())))
    assert got["b"] == 4.0 and got["c"] == 4.0 and got.get("a", 0) == 0


def test_resolve_calls(spark, nodes, edges):
    n = nodes(("caller", "main()"), ("one", "unique()"), ("t1", "twice()"), ("t2", "twice()"), ("done", "linked()"))
    calls = spark.createDataFrame([("caller", c, m, "a.py") for c, m in (("Unique", False), ("twice", False), ("unique", True), ("main", False), ("linked", False))], "caller string, callee string, is_member boolean, source_file string")
    none = spark.createDataFrame([], "source_file string, id string")
    got = resolve.resolve_calls(n, edges(("caller", "done")), calls, none)
    assert rows(got, "src", "dst", "confidence", "confidence_score") == [("caller", "one", "INFERRED", 0.8)]
    seen = spark.createDataFrame([("a.py", "one")], "source_file string, id string")
    assert rows(resolve.resolve_calls(n, edges(("x", "y")), calls.filter("callee = 'Unique'"), seen), "dst", "confidence") == [("one", "EXTRACTED")]


def test_other_resolutions(spark):
    sy = spark.createDataFrame([("m", "f", "m_f"), ("m", "g", "g1"), ("m", "g", "g2")], "module string, symbol string, id string")
    al = spark.createDataFrame([("a.py", "ff", "m", "f"), ("a.py", "g", "m", "g")], "file string, local string, module string, symbol string")
    ca = spark.createDataFrame([("a_main", "ff", "a.py"), ("a_main", "g", "a.py"), ("b", "ff", "b.py")], "caller string, callee string, file string")
    assert rows(resolve.import_guided_calls(sy, al, ca)) == [("a_main", "m_f", "calls")]
    cl = spark.createDataFrame([("a.py", "A"), ("a.py", "B")], "file string, id string")
    im = spark.createDataFrame([("a.py", "X"), ("a.py", "A")], "file string, target string")
    assert rows(resolve.class_imports(cl, im), "src", "dst") == [("A", "X"), ("B", "A"), ("B", "X")]
    n = spark.createDataFrame([("t", "T", False), ("x", "T", True), ("u", "U", True)], "id string, label string, is_extension boolean")
    e = spark.createDataFrame([("x", "m"), ("x", "t")], "src string, dst string")
    left, moved = resolve.merge_extensions(n, e)
    assert rows(left, "id") == [("t",), ("u",)] and rows(moved) == [("t", "m")]


@pytest.mark.parametrize("a,b,want", [("martha", "marhta", 0.9611), ("dwayne", "duane", 0.84), ("dixon", "dicksonx", 0.8133), ("", "x", 0.0), ("same", "same", 1.0)])
def test_jaro_winkler(a, b, want):
    assert keys._jaro_winkler(a, b) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("a,b,want", [("ca", "abc", 2), ("ab", "ba", 1), ("kitten", "sitting", 3), ("", "ab", 2), ("x", "x", 0)])
def test_damerau(a, b, want):
    assert keys._damerau(a, b) == want


def test_keys(spark):
    df = spark.createDataFrame([("Session_ValidateToken!", ".run()", "Ｆull ＷIDTH", "Crème Brûlée")], "a string, b string, c string, d string")
    r = df.select(keys.id_key(F.col("a")), keys.call_key(F.col("b")), keys.dedup_key(F.col("c"), True), keys.search_key(F.col("d"), True), keys.stub_key(F.col("a")), keys.file_stem(F.lit("src/pkg/mod.test.py")), keys.suffix(F.lit("a/.env"))).first()
    assert tuple(r) == ("session_validatetoken", "run", "full width", "creme brulee", "sessionvalidatetoken", "pkg.mod.test", "")


def test_entities_merge_and_variants_stay(spark, nodes, edges):
    n = nodes(("graph_extractor", "Graph Extractor", "code", "a.py"), ("graph_extractor_c1", "graph  extractor", "code", "a.py"), ("authentication_manager", "Authentication Manager", "code", "b.py"), ("authentication_manger", "Authentication Manger", "code", "c.py"), ("asr1603", "ASR1603"), ("asr1605", "ASR1605"), ("ai", "AI"), ("ml", "ML"))
    remap = dedup.resolve_entities(n)
    assert rows(remap) == [("authentication_manager", "authentication_manger"), ("graph_extractor_c1", "graph_extractor")]
    e = edges(("graph_extractor_c1", "ai"), ("graph_extractor", "graph_extractor_c1"))
    assert rows(dedup.rewrite_edges(e, remap), "src", "dst") == [("graph_extractor", "ai")]
    left = n.join(remap.select("id"), "id", "left_anti")
    assert dedup.exact_duplicates(left).count() == 0  # resolving twice changes nothing


def test_similar_pairs_like_brute_force(spark):
    import random

    r = random.Random(3)
    words = [("".join(r.choice("abc") for _ in range(r.randint(1, 9))),) for _ in range(120)]
    k = spark.createDataFrame(sorted(set(words)), "key string")
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)} if len(s) >= 3 else {s}
    ks = sorted({w for (w,) in words})
    want = [(a, b) for a in ks for b in ks if a < b and len(grams(a) & grams(b)) >= 0.7 * len(grams(a) | grams(b))]
    assert rows(dedup.similar_pairs(k), "a", "b") == want


def test_communities_are_a_partition(spark, edges):
    e = [(f"{g}{i}", f"{g}{j}") for g in "xyz" for i in range(5) for j in range(i)] + [("x0", "y0"), ("y1", "z1")]
    s = build.collapse_edges(edges(*e))
    c = cluster.communities(s)
    got = {r["id"]: r["community"] for r in c.collect()}
    assert len(got) == 15 and all(len({got[f"{g}{i}"] for i in range(5)}) == 1 for g in "xyz") and set(got.values()) == {0, 1, 2}
    same = {r["id"]: r["community"] for r in cluster.remap(c, c.withColumn("community", F.col("community") + 7)).collect()}
    assert set(same.values()) == {7, 8, 9}


def test_detection(spark):
    f = spark.createDataFrame([("a/b.py", ""), ("run", "#!/usr/bin/env -S python3 -u\n"), ("x", "plain"), ("n.md", "Abstract. See [3], doi: 1"), ("n.txt", "hi"), ("i.imageset/p.pdf", ""), ("t.PNG", ""), ("v.blade.php", "")], "path string, content string")
    got = dict(f.select("path", detect.classify(F.col("path"), F.col("content"))).collect())
    assert got == {"a/b.py": "code", "run": "code", "x": None, "n.md": "paper", "n.txt": "document", "i.imageset/p.pdf": None, "t.PNG": "image", "v.blade.php": "code"}
    p = spark.createDataFrame([(x,) for x in (".ssh/config", "a/.env", "my_token.txt", "tokenizer.py", "keys/id_rsa", "a/b.py")], "path string")
    assert [r[1] for r in p.select("path", detect.is_sensitive(F.col("path"))).collect()] == [True, True, True, False, True, False]


def test_manifest(spark):
    f = spark.createDataFrame([("a", 1.0, "h1"), ("b", 2.0, "h2")], "path string, mtime double, hash string")
    old = spark.createDataFrame([("a", 0.0, "h1", "s"), ("b", 0.0, "x", "s")], "path string, mtime double, ast_hash string, semantic_hash string")
    assert rows(detect.save_manifest(f, old, "ast")) == [("a", 1.0, "h1", "s"), ("b", 2.0, "h2", None)]
    assert detect.load_manifest(spark, "/nowhere/at/all").count() == 0


def test_pull_requests(spark):
    r = spark.createDataFrame([(["FAILURE"], []), (["SUCCESS"], ["QUEUED"]), (["SUCCESS"], ["COMPLETED"]), ([], [])], "c array<string>, s array<string>")
    assert [x[0] for x in r.select(prs.ci_status(F.col("c"), F.col("s"))).collect()] == ["FAILURE", "PENDING", "SUCCESS", "NONE"]
    b = spark.createDataFrame([(1, 1), (5, 2), (0, 0)], "n int, c int")
    assert [x[0] for x in b.select(prs.blast_radius(F.col("n"), F.col("c"))).collect()] == ["1 node / 1 community", "5 nodes / 2 communities", ""]


def test_preferred_edges_fall_back(edges):
    e = edges(("a", "b", "contains", "EXTRACTED"), ("a", "c", "calls", "AMBIGUOUS"))
    assert diagram.preferred_edges(e).count() == 1


def test_rationale_folds_into_its_target(nodes, edges):
    n = nodes(("w", "Decision: we keep the old parser because of speed."), ("p", "Parser"), ("c", "Idea", "concept"))
    left, e = build.fold_rationale(n, edges(("w", "p", "rationale_for", "EXTRACTED"), ("c", "p")))
    assert rows(left, "id", "rationale") == [("p", ["Decision: we keep the old parser because of speed."])] and e.count() == 0


def test_render_keeps_to_its_budget(spark, nodes, edges):
    s = build.collapse_edges(edges(*[("hub", f"n{i}") for i in range(30)]))
    nb, deg, n = analyze.neighbors(s), analyze.degree(s), nodes(("hub", "Hub\x07"), *[(f"n{i}",) for i in range(30)])
    reached, via = traverse.bfs(nb, deg, spark.createDataFrame([("hub",)], "id string"), 1, 50)
    full = search.render(reached, via, n, deg, s)
    assert full.startswith("NODE Hub [src=hub.py loc= community=0]\n") and full.count("EDGE Hub --calls [EXTRACTED]--> ") == 30
    short = search.render(reached, via, n, deg, s, tokens=100)
    assert len(short) < 400 and short.count("NODE ") + int(short.split("truncated: ")[1].split()[0]) == 31


def test_fragments(spark, nodes, edges):
    h = spark.createDataFrame([("h", ["a"]), ("g", ["a", "b"]), ("big", [str(i) for i in range(300)])], "id string, members array<string>")
    got = build.fragment_errors(nodes(("a",), (" ",), ("x" * 300,)), edges(("a", "b\x01"), (None, "a")), h)
    assert sorted((r["kind"], r["row_id"][:5]) for r in got.collect()) == [("edge_id", "?"), ("edge_id", "b\x01"), ("hyperedge_members", "big"), ("hyperedge_members", "h"), ("node_id", " "), ("node_id", "xxxxx")]
    s = "id string, label string, file_type string, ord long"
    one = (spark.createDataFrame([("a", "first", None, 5)], s), edges(("a", "b")))
    two = (spark.createDataFrame([("a", "second", "code", 1)], s), edges(("b", "a")))
    n, e = build.union_fragments(one, two)
    assert n.orderBy("ord").first()["label"] == "first" and e.count() == 2
    assert rows(build.upsert_nodes(n.limit(0), n, "first"), "label") == [("first",)]
    assert spark.range(1).select(build.cost(F.lit(2_000_000), F.lit(1_000_000), 1.5, 2.0)).first()[0] == 5.0


def test_edge_diagnostics_counts(spark, nodes):
    from weftgraph.operators import diagnostics

    s = "src string, dst string, relation string, confidence string, context string, source_file string"
    e = spark.createDataFrame([("a", "b", "calls", "E", None, "f"), ("a", "b", "calls", "E", None, "f"), ("a", "b", "uses", "E", "x", "f"), ("b", "a", "calls", "E", None, "g"), ("a", "gone", "calls", "E", None, "f"), ("a", None, "calls", "E", None, "f"), ("b", "b", "calls", "E", None, "f")], s)
    r = diagnostics.edge_diagnostics(nodes(("a",), ("b",)), e).first().asDict()
    assert r == {"total": 7, "missing_endpoint": 1, "dangling": 1, "self_loops": 1, "valid": 5, "exact_duplicates": 1, "directed_collapse": 2, "undirected_collapse": 3}
    assert rows(diagnostics.same_endpoint_groups(e.filter("dst = 'b'"))) == [("a", "b", 3, 2, 1, 1, 2)]


def test_communities_split_and_hubs(spark, nodes, edges):
    s = build.collapse_edges(edges(*[(f"a{i}", f"a{j}") for i in range(6) for j in range(i)], *[(f"b{i}", f"b{j}") for i in range(6) for j in range(i)], ("a0", "b0")))
    whole = s.select(F.explode(F.array("lo", "hi")).alias("id")).distinct().withColumn("community", F.lit(0))
    assert cluster.split_oversized(s, whole).select("community").distinct().count() == 2
    n = nodes(*[(f"{g}{i}", "x", "code", "f.py", k) for k, g in enumerate("ab") for i in range(6)])
    hubs = spark.createDataFrame([("a0",)], "id string")
    assert rows(analyze.hub_reattach(hubs, s, n)) == [("a0", 0)]
