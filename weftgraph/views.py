"""Graph views of the relational tables.

Each view is one SQL text that both Spark and DuckDB read; ``{name}`` stands for a
table.  Spark gets the Parquet path there, so scans keep pushdown and pruning.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: Nodes of the foreign-key graph; communities follow regions, parts have their own.
FK_NODES = """
SELECT 'region:' || r_regionkey AS id, r_name AS label, 'document' AS file_type, 'world/region.md' AS source_file, CAST(r_regionkey AS INT) AS community FROM {region}
UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'code', 'world/nation.py', CAST(n_regionkey AS INT) FROM {nation}
UNION ALL SELECT 'customer:' || c_custkey, c_name, 'code', 'crm/customer_' || (c_custkey % 20) || '.py', CAST(n_regionkey AS INT) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'code', 'supply/supplier_' || (s_suppkey % 5) || '.go', CAST(n_regionkey AS INT) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT 'part:' || p_partkey, p_name, 'paper', 'catalog/part_' || (p_partkey % 50) || '.pdf', CAST(5 + p_size % 5 AS INT) FROM {part}
UNION ALL SELECT 'order:' || o_orderkey, o_orderpriority || ' ' || o_orderkey, 'code', 'sales/orders_' || (o_orderkey % 100) || '.java', CAST(n_regionkey AS INT) FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""
FK_EDGES = """
SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'contains' AS relation, 'EXTRACTED' AS confidence, CAST(NULL AS DOUBLE) AS confidence_score, CAST(NULL AS VARCHAR(20)) AS context, CAST(1 AS DOUBLE) AS weight, 'world/nation.py' AS source_file, CAST(n_nationkey AS BIGINT) AS ord FROM {nation}
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'references', 'EXTRACTED', CAST(NULL AS DOUBLE), 'field', CAST(1 AS DOUBLE), 'crm/customer_' || (c_custkey % 20) || '.py', c_custkey FROM {customer}
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'references', 'EXTRACTED', CAST(NULL AS DOUBLE), 'field', CAST(1 AS DOUBLE), 'supply/supplier_' || (s_suppkey % 5) || '.go', s_suppkey FROM {supplier}
UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'references', 'EXTRACTED', CAST(NULL AS DOUBLE), 'field', CAST(1 AS DOUBLE), 'sales/orders_' || (o_orderkey % 100) || '.java', o_orderkey FROM {orders}
UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'calls', CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'A' THEN 'INFERRED' ELSE 'AMBIGUOUS' END, CASE WHEN l_returnflag = 'A' THEN round(0.5 + 5 * l_discount, 2) END, 'call', l_quantity, 'sales/orders_' || (l_orderkey % 100) || '.java', (l_orderkey * 10 + l_linenumber) * 100000 + CAST(floor(l_extendedprice) AS BIGINT) % 100000 FROM {lineitem}
UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'uses', CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'A' THEN 'INFERRED' ELSE 'AMBIGUOUS' END, CASE WHEN l_returnflag = 'A' THEN round(0.5 + 5 * l_discount, 2) END, 'import', l_quantity, 'catalog/part_' || (l_partkey % 50) || '.pdf', (l_orderkey * 10 + l_linenumber) * 100000 + CAST(floor(l_extendedprice) AS BIGINT) % 100000 FROM {lineitem}
"""
#: Documents and pages as files.
FILES = """
SELECT 'docs/' || source || '/d' || doc_id || CASE doc_id % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.py' WHEN 3 THEN '.pdf' WHEN 4 THEN '.png' WHEN 5 THEN '.mp4' ELSE '' END AS path, text AS content FROM {documents}
UNION ALL SELECT 'web/p' || page_id || '.html', html FROM {pages}
"""
#: Orders as pull requests against a fixed day, their parts as changed files.
PRS = """
SELECT o_orderkey AS number, CASE WHEN o_custkey % 11 = 0 THEN 'release' ELSE 'main' END AS base_branch, CASE o_orderstatus WHEN 'F' THEN 'FAILURE' WHEN 'P' THEN 'PENDING' ELSE 'SUCCESS' END AS ci_status, CASE WHEN o_orderkey % 5 = 0 THEN 'CHANGES_REQUESTED' WHEN o_orderkey % 5 = 1 THEN 'APPROVED' ELSE '' END AS review_decision, o_orderkey % 13 = 0 AS is_draft, CAST(o_orderdate AS DATE) AS updated_on FROM {orders}
"""


def for_duckdb(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


class Catalog:
    """Tables and views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(re.sub(r"\{(\w+)\}", rf"parquet.`{self.dir}/\1.parquet`", text))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def nodes(self) -> DataFrame:
        return self.sql(FK_NODES)

    @cached_property
    def edges(self) -> DataFrame:
        return self.sql(FK_EDGES)

    @cached_property
    def files(self) -> DataFrame:
        return self.sql(FILES)

    @cached_property
    def prs(self) -> DataFrame:
        return self.sql(PRS)
