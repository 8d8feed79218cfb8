"""The catalogue's queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from weftgraph.plans.catalog import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
SOME = ["god_nodes", "collapse_edges", "endpoint_repair", "surprise_scores", "node_search", "bfs_nodes", "affected", "dedup_rewrite", "pr_impact", "sections", "incremental_diff", "html_text"]

needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def norm(rows):
    return sorted(tuple("~" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@needs_tables
@pytest.mark.parametrize("name", SOME)
def test_like_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert norm(tuple(r) for r in df.select(*cols).collect()) == norm(want)


@needs_tables
def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_every_query_is_registered():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
