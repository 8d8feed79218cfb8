"""Ways of the graph queries that larger tables ask for, on small inputs."""

import datetime

import numpy as np
import pytest

from pyspark.sql import functions as F

from weftgraph.operators import build, overlap, traverse
from weftgraph.plans.catalog import QUERIES


@pytest.fixture
def no_parts(spark, tmp_path):
    """Tables in which no part lies three steps from region 1."""
    data = {
        "region": ([(1, "R1")], "r_regionkey long, r_name string"),
        "nation": ([(2, "N2", 1)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(3, "C3", 2)], "c_custkey long, c_name string, c_nationkey long"),
        "supplier": ([], "s_suppkey long, s_name string, s_nationkey long"),
        "part": ([(4, "P4", 1)], "p_partkey long, p_name string, p_size long"),
        "orders": ([(5, 3, "1-URGENT", "F", datetime.date(1998, 1, 1))], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate date"),
        "lineitem": ([(5, 4, 6, 1, "N", 0.05, 3.0, 100.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_returnflag string, l_discount double, l_quantity double, l_extendedprice double"),
    }
    for name, (rows, schema) in data.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_shortest_path_query_reads_ends_only(spark, no_parts, monkeypatch):
    def collapse(*_):
        raise AssertionError("edges needn't be collapsed for a path")

    monkeypatch.setattr(build, "collapse_edges", collapse)
    assert QUERIES["shortest_path"](spark, no_parts).collect() == []  # as in SQL, not the region alone


@pytest.mark.parametrize("front", [500_000, 0])
def test_shortest_path_with_repeated_pairs(spark, front, monkeypatch):
    monkeypatch.setattr(traverse, "FRONT", front)
    one = [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "a"), ("x", "y")]
    nb = spark.createDataFrame([p for a, b in one for p in ((a, b), (b, a))] * 2, "id string, other string")
    path = lambda *a: [r["id"] for r in traverse.shortest_path(nb, *a).orderBy("step").collect()]
    assert path("a", "e") == ["a", "b", "d", "e"] and path("a", "a") == ["a"] and path("a", "x") == [] and path("a", "e", 2) == []


def _grams(key):
    bare = key.replace(" ", "")
    return {bare[i : i + 3] for i in range(len(bare) - 2)} or {bare}


@pytest.mark.parametrize("least", [0.3, 0.5, 0.55, 0.7, 1.0])
def test_overlaps_like_brute_force(spark, least):
    import random

    r = random.Random(5)
    keys = {"".join(r.choice("abé ") for _ in range(r.randint(1, 12))).strip() for _ in range(150)} | {"x", "xy", "x y", "long shared key one", "long shared key two", "\U0001f600ab", "\U0001f600abc"}
    keys = sorted(keys - {""})
    want = {}
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = _grams(a), _grams(b)
            if (j := len(x & y) / len(x | y)) >= least:
                want[a, b] = j
    got = overlap.similar_pairs(spark.createDataFrame([(k,) for k in keys], "key string").repartition(3), least).collect()
    assert {(x["a"], x["b"]): x["overlap"] for x in got} == want and len(got) == len(want) > 0


def _random_keys(spark, n):
    import random

    r = random.Random(7)
    return spark.createDataFrame([("".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(16)),) for _ in range(n)], "key string")


@pytest.mark.parametrize("least,most", [(0.7, 50), (0.5, 200)])
def test_random_keys_are_few_candidates(spark, least, most):
    """A prefix of single shingles meets in thousands of the 4.5 million pairs."""
    from weftgraph.store import stored

    keys = stored(_random_keys(spark, 3000).select(F.monotonically_increasing_id().alias("ref"), "key"), "test")
    assert overlap.candidates(keys, 3000, least).count() <= most


def test_hot_signatures_are_sliced(monkeypatch):
    import numpy as np

    monkeypatch.setattr(overlap, "CANDIDATES", 10)
    ref, sig = np.arange(9), np.zeros(9, np.uint64)
    got = [(a, b) for x in overlap._matches((sig, ref), (sig, ref)) for a, b in zip(*(y.tolist() for y in x), strict=True)]
    assert set(got) == {(a, b) for a in range(9) for b in range(a + 1, 9)}


def _random_pairs(spark, nodes, pairs):
    import random

    r = random.Random(11)
    some = {tuple(sorted(r.sample(range(nodes), 2))) for _ in range(pairs)} | {(0, 0)}
    return spark.createDataFrame([tuple(sorted((f"n{a}", f"n{b}"))) for a, b in some], "lo string, hi string")


def test_packed_communities_like_joins(spark, monkeypatch):
    from weftgraph.operators import cluster, packed

    pairs = _random_pairs(spark, 60, 110)
    found = [{r["id"]: r["community"] for r in cluster.communities(pairs, levels=2, sweeps=4).collect()}]
    monkeypatch.setattr(packed, "NODES", 0)
    found.append({r["id"]: r["community"] for r in cluster.communities(pairs, levels=2, sweeps=4).collect()})
    assert found[0] == found[1] and len(found[0]) > len(set(found[0].values())) > 1


def test_communities_are_not_joined(spark, monkeypatch):
    from weftgraph.operators import cluster

    def joined(*_):
        raise AssertionError("a sweep by joins shuffles every edge")

    monkeypatch.setattr(cluster, "_level", joined)
    assert cluster.communities(_random_pairs(spark, 20, 30)).select("id").distinct().count() > 10


@pytest.mark.parametrize("slices", [2_000_000, 3])
def test_packed_betweenness_like_joins(spark, monkeypatch, slices):
    pairs = _random_pairs(spark, 30, 45)
    nb = pairs.selectExpr("lo AS id", "hi AS other").union(pairs.selectExpr("hi", "lo"))
    some = spark.createDataFrame([("n1",), ("n2",), ("n3",), ("none",)], "id string")
    score = lambda: {r["id"]: r["score"] for r in traverse.betweenness(nb, some).collect()}
    want = score() if slices == 3 else None
    monkeypatch.setattr(traverse, "SLICE", slices)
    got = score()
    if want is None:
        monkeypatch.setattr(traverse, "EDGES", 0)
        want = score()
    assert got == pytest.approx(want, abs=1e-5) and len(got) > 10 and max(got.values()) > 0


def test_betweenness_is_not_joined(spark, monkeypatch):
    def joined(*_):
        raise AssertionError("every pivot's nodes would be shuffled at each level")

    monkeypatch.setattr(traverse, "_flows", joined)
    nb = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "id string, other string")
    assert {r["id"]: r["score"] for r in traverse.betweenness(nb, nb.select("id").distinct()).collect()} == {"a": 0.0, "b": 2.0, "c": 0.0}


def test_betweenness_leaves_numbers_only(spark, tmp_path, monkeypatch):
    """Edges are exchanged and kept as numbers: no table of their ids, of blocks or of scores stays."""
    from weftgraph import store
    from weftgraph.operators import mapped

    nb = _random_pairs(spark, 50, 90).selectExpr("inline(array(named_struct('id', lo, 'other', hi), named_struct('id', hi, 'other', lo)))")
    monkeypatch.setattr(store, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(mapped, "shared_dir", store.shared_dir)
    score = traverse.betweenness(nb).count()
    assert score > 40 and [x.name.rpartition("-")[0] for x in tmp_path.iterdir()] == ["graph-numbers"]


def test_graph_of_equal_hashes_is_joined(spark, monkeypatch):
    from weftgraph.operators import mapped

    nb = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "id string, other string")
    monkeypatch.setattr(mapped, "_hashes", lambda _: None)
    assert {r["id"]: r["score"] for r in traverse.betweenness(nb).collect()} == {"a": 0.0, "b": 2.0, "c": 0.0}


@pytest.mark.parametrize("cliques", [4, 40])
@pytest.mark.parametrize("nodes", [20_000_000, 0])
def test_large_and_loose_communities_are_split(spark, nodes, cliques, monkeypatch):
    """A ring of 60 nodes, one community at a low resolution, has more than a quarter of the nodes beside 4 cliques of 5; beside 40 only few of its edges."""
    from weftgraph.operators import cluster, packed

    pairs = [tuple(sorted((f"r{i:02}", f"r{(i + 1) % 60:02}"))) for i in range(60)] + [(f"{g:02}{i}", f"{g:02}{j}") for g in range(cliques) for j in range(5) for i in range(j)]
    monkeypatch.setattr(packed, "NODES", nodes)
    start = {"_packed_parts": lambda _, turns, *a: np.array([int(n >= 5 * cliques) * 5 * cliques if n >= 5 * cliques else n // 5 * 5 for n in range(len(turns))], np.int32), "_parts_by_joins": lambda e, *_: e.select(F.explode(F.array("u", "v")).alias("id")).distinct().selectExpr("id", "if(id LIKE 'r%', 'r00', concat(substr(id, 1, 2), '0')) AS com")}
    for name, first in start.items():  # the first pass makes components
        real, calls = getattr(cluster, name), []
        monkeypatch.setattr(cluster, name, lambda *a, first=first, real=real, calls=calls: real(*a) if calls else (calls.append(1), first(*a))[1])
    got = {r["id"]: r["community"] for r in cluster.communities(spark.createDataFrame(pairs, "lo string, hi string"), levels=2, sweeps=3).collect()}
    assert len(got) == 60 + 5 * cliques and len({got[f"r{i:02}"] for i in range(60)}) > 4
    assert all(len({got[f"{g:02}{i}"] for i in range(5)}) == 1 for g in range(cliques))


def test_communities_go_on_until_nothing_is_gained(spark):
    """Without bounds the modularity is above that of a bounded run."""
    from weftgraph.operators import cluster

    pairs = _random_pairs(spark, 80, 160)
    labels = {r["id"]: r["community"] for r in cluster.communities(pairs, split=False).collect()}
    edges = [(r["lo"], r["hi"]) for r in pairs.collect()]
    two_m, mass, degree = 2 * len(edges), {}, {}
    for e in edges:
        for x in e:
            degree[x] = degree.get(x, 0) + 1
            mass[labels[x]] = mass.get(labels[x], 0) + 1
    quality = sum(labels[a] == labels[b] for a, b in edges) / len(edges) - sum(m * m for m in mass.values()) / two_m**2
    few = {r["id"]: r["community"] for r in cluster.communities(pairs, levels=1, sweeps=2, split=False).collect()}
    few_mass = {}
    for e in edges:
        for x in e:
            few_mass[few[x]] = few_mass.get(few[x], 0) + 1
    assert quality > 0.3 and quality > sum(few[a] == few[b] for a, b in edges) / len(edges) - sum(m * m for m in few_mass.values()) / two_m**2


def test_isolates_are_communities(spark):
    from weftgraph.operators import cluster

    labels = spark.createDataFrame([("a", 0), ("b", 0), ("d", 1), ("e", 1)], "id string, community int")
    got = {r["id"]: r["community"] for r in cluster.with_isolates(labels, spark.createDataFrame([(x,) for x in "abcde"], "id string")).collect()}
    assert got == {"a": 0, "b": 0, "d": 1, "e": 1, "c": 2}


def test_signatures_take_turns(spark, tmp_path, monkeypatch):
    """With few bytes at a time the same pairs are found in several rounds."""
    keys = _random_keys(spark, 400).union(spark.createDataFrame([("a shared long key 1",), ("a shared long key 2",)], "key string"))
    want = {(r["a"], r["b"]) for r in overlap.similar_pairs(keys, 0.5).collect()}
    rounds = []
    real = overlap.stored
    monkeypatch.setattr(overlap, "stored", lambda df, label: (rounds.append(label), real(df, label))[1])
    monkeypatch.setattr(overlap, "ROUND", 1)
    assert {(r["a"], r["b"]) for r in overlap.similar_pairs(keys, 0.5).collect()} == want >= {("a shared long key 1", "a shared long key 2")}
    assert rounds.count("candidates") > 2


def test_ambiguous_pairs_of_all_pairs(spark, monkeypatch):
    """Pairs of few shingles in common are judged too; small blocks, so that several meet."""
    import random

    from weftgraph.functions.keys import _jaro_winkler
    from weftgraph.operators import alike, dedup

    monkeypatch.setattr(alike, "PAIRS", 7)
    r = random.Random(3)
    words = {"".join(r.choice("abcdé") for _ in range(r.randint(12, 18))) for _ in range(60)} | {"graph extractor one", "grxph extrxctor onx", "short"}
    words = sorted(words)
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if min(len(a), len(b)) >= 12 and 75 <= _jaro_winkler(a, b) * 100 < 92}
    nodes = spark.createDataFrame([(str(i), w) for i, w in enumerate(words)], "id string, label string").repartition(3)
    got = [(x["a"], x["b"]) for x in dedup.ambiguous_pairs(nodes).collect()]
    assert set(got) == want and len(got) == len(want) and ("graph extractor one", "grxph extrxctor onx") in want
    few = {(x["a"], x["b"]) for x in dedup.ambiguous_pairs(nodes, overlapping=0.5).collect()}
    assert few < want


def test_jaro_of_many_like_one():
    import random

    from weftgraph.functions.keys import _jaro_winkler
    from weftgraph.operators import alike

    r = random.Random(4)
    pairs = [["".join(r.choice("abc\U0001f600") for _ in range(r.randint(1, 12))) for _ in "ab"] for _ in range(300)]
    got = alike.jaro(*(alike._padded(list(x)) for x in zip(*pairs, strict=True)))
    for (a, b), j in zip(pairs, got, strict=True):
        prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(len(a), len(b), 4))
        assert _jaro_winkler(a, b) == pytest.approx(j + prefix * 0.1 * (1 - j) if j > 0.7 else j)
