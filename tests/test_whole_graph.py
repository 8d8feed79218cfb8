"""Graph queries without SQL see every table: small tables, with results worked out in Python."""

import datetime
import random
from collections import deque

import pytest

from weftgraph.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The folder, and the pairs of nodes that share an edge."""
    r, folder = random.Random(2), str(tmp_path_factory.mktemp("tables"))
    nations = [(i, f"N{i}", i % 2) for i in range(4)]
    customers, suppliers = [(i, f"C{i}", r.randrange(4)) for i in range(8)], [(i, f"S{i}", r.randrange(4)) for i in range(4)]
    orders = [(i, r.randrange(8)) for i in range(20)]
    lines = [(o, r.randrange(9), r.randrange(4), n) for o, _ in orders for n in range(r.randint(1, 3))]
    day = datetime.date(1998, 1, 1)
    data = {
        "region": ([(0, "R0"), (1, "R1")], "r_regionkey long, r_name string"),
        "nation": (nations, "n_nationkey long, n_name string, n_regionkey long"),
        "customer": (customers, "c_custkey long, c_name string, c_nationkey long"),
        "supplier": (suppliers, "s_suppkey long, s_name string, s_nationkey long"),
        "part": ([(i, f"P{i}", i) for i in range(9)], "p_partkey long, p_name string, p_size long"),
        "orders": ([(o, c, "1-URGENT", "F", day) for o, c in orders], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate date"),
        "lineitem": ([(*x, "N", 0.05, 3.0, 100.0) for x in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_returnflag string, l_discount double, l_quantity double, l_extendedprice double"),
    }
    for name, (rows, schema) in data.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    pairs = {(f"nation:{i}", f"region:{g}") for i, _, g in nations} | {(f"customer:{i}", f"nation:{n}") for i, _, n in customers} | {(f"supplier:{i}", f"nation:{n}") for i, _, n in suppliers}
    pairs |= {(f"order:{o}", f"customer:{c}") for o, c in orders} | {(f"order:{o}", f"part:{p}") for o, p, _, _ in lines} | {(f"part:{p}", f"supplier:{s}") for _, p, s, _ in lines}
    return folder, pairs


def adjacency(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def brandes(near, sources):
    score = {}
    for s in sources:
        level, paths, order, todo = {s: 0}, {s: 1.0}, [], deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in level:
                    level[w], paths[w] = level[v] + 1, 0.0
                    todo.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
        dep = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if level[v] == level[w] - 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                score[w] = score.get(w, 0.0) + dep[w]
    return score


def test_betweenness_of_all_nodes(spark, tables):
    folder, pairs = tables
    near = adjacency(pairs)
    got = {r["id"]: r["score"] for r in QUERIES["betweenness"](spark, folder).collect()}
    assert got == pytest.approx(brandes(near, near), abs=1e-5)
    assert {x.split(":")[0] for x, s in got.items() if s > 0} >= {"customer", "order", "part", "supplier", "nation"}


def test_pivots_of_a_large_graph(spark):
    from weftgraph.operators import traverse

    ring = spark.range(40).selectExpr("concat('n', id) AS id", "concat('n', (id + 1) % 40) AS other")
    ring = ring.union(ring.select("other", "id"))
    assert traverse.pivots(ring, exact=40).count() == 40
    some = [{r["id"] for r in traverse.pivots(x, 39, 7).collect()} for x in (ring, ring.repartition(5))]
    assert len(some[0]) == 7 and some[0] == some[1]
    got = {r["id"]: r["score"] for r in traverse.betweenness(ring, traverse.pivots(ring, 39, 7)).collect()}
    near = adjacency({(f"n{i}", f"n{(i + 1) % 40}") for i in range(40)})
    assert got == pytest.approx(brandes(near, some[0]), abs=1e-5)


@pytest.mark.parametrize("name", ["communities", "community_remap"])
def test_communities_see_every_edge(spark, tables, name, monkeypatch):
    from pyspark.sql import functions as F

    from weftgraph.operators import cluster

    seen = []

    def whole(simple):  # a single community, as the sweeps take a minute
        seen.append({(r["lo"], r["hi"]) for r in simple.select("lo", "hi").collect()})
        return simple.select(F.explode(F.array("lo", "hi")).alias("id")).distinct().withColumn("community", F.lit(0))

    monkeypatch.setattr(cluster, "communities", whole)
    folder, pairs = tables
    rows = QUERIES[name](spark, folder).collect()
    assert seen == [{(min(p), max(p)) for p in pairs}]
    assert sorted(r["id"] for r in rows) == sorted(adjacency(pairs))
