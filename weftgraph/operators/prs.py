"""Pull requests against the graph: status, impact, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import base_name

# States in the order of a dashboard, days after which a request is stale, failed conclusions.
STATUSES = ["WRONG-BASE", "CI-FAIL", "CHANGES-REQ", "DRAFT", "STALE", "PENDING", "APPROVED", "READY"]
STALE_DAYS = 14
FAILED = ["FAILURE", "CANCELLED", "TIMED_OUT", "ACTION_REQUIRED", "STARTUP_FAILURE"]


def ci_status(conclusions: Column, statuses: Column) -> Column:
    """FAILURE, PENDING, SUCCESS or NONE of arrays of check conclusions and states."""
    has = lambda c, names: F.coalesce(F.arrays_overlap(c, F.array(*(F.lit(n) for n in names))), F.lit(False))
    return F.when(has(conclusions, FAILED), "FAILURE").when(has(statuses, ["IN_PROGRESS", "QUEUED"]), "PENDING").when(has(conclusions, ["SUCCESS"]), "SUCCESS").otherwise("NONE")


def status(base: str, today: str) -> Column:
    """State of a request; the first rule that holds."""
    return (
        F.when(F.col("base_branch") != base, "WRONG-BASE")
        .when(F.col("ci_status") == "FAILURE", "CI-FAIL")
        .when(F.col("review_decision") == "CHANGES_REQUESTED", "CHANGES-REQ")
        .when(F.col("is_draft"), "DRAFT")
        .when(F.datediff(F.lit(today).cast("date"), F.col("updated_on")) >= STALE_DAYS, "STALE")
        .when(F.col("review_decision") == "APPROVED", "APPROVED")
        .when(F.col("ci_status") == "PENDING", "PENDING")
        .otherwise("READY")
    )


def open_requests(snapshot: DataFrame, base: str = "main") -> DataFrame:
    """Requests of a snapshot, as hosting services list them in JSON: number, title, headRefName, baseRefName, author.login,
    isDraft, reviewDecision, statusCheckRollup (conclusion and status) and updatedAt."""
    checks = lambda field: F.transform(F.coalesce("statusCheckRollup", F.array().cast(snapshot.schema["statusCheckRollup"].dataType)), lambda x: x[field])
    return snapshot.select(
        "number",
        "title",
        F.col("headRefName").alias("branch"),
        F.col("baseRefName").alias("base_branch"),
        F.coalesce("author.login", F.lit("?")).alias("author"),
        F.coalesce("isDraft", F.lit(False)).alias("is_draft"),
        F.coalesce("reviewDecision", F.lit("")).alias("review_decision"),
        ci_status(checks("conclusion"), checks("status")).alias("ci_status"),
        F.to_date("updatedAt").alias("updated_on"),
        F.lit(base).alias("expected_base"),
    )


def read_requests(spark: SparkSession, path: str, base: str = "main") -> DataFrame:
    """``open_requests`` of JSON files."""
    fields = "number long, title string, headRefName string, baseRefName string, author struct<login: string>, isDraft boolean, reviewDecision string, statusCheckRollup array<struct<conclusion: string, status: string>>, updatedAt timestamp"
    return open_requests(spark.read.schema(fields).option("multiLine", True).json(path), base)


def in_order(requests: DataFrame, base: str, today: str) -> DataFrame:
    """Requests with ``status`` and ``place``: the order of a dashboard, those longest without a change first."""
    rank = F.array_position(F.array(*(F.lit(x) for x in STATUSES)), F.col("status"))
    return requests.withColumn("status", status(base, today)).withColumn("place", rank).orderBy("place", "updated_on", "number")


def impact(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(number, communities, nodes) touched by the files (number, file) of each request.

    A graph file matches if one path ends in the other at a folder boundary; file names
    block the join, so it is an equi-join.
    """
    files = nodes.filter(F.coalesce("source_file", F.lit("")) != "").groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.collect_set("community").alias("c"))
    files = files.withColumn("name", base_name(F.col("source_file")))
    pr = changed.select("number", F.col("file").alias("f"), base_name(F.col("file")).alias("name")).distinct()
    src, f = F.col("source_file"), F.col("f")
    same = (src == f) | F.endswith(src, F.concat(F.lit("/"), f)) | F.endswith(f, F.concat(F.lit("/"), src))
    hit = pr.join(files, "name").filter(same).select("number", "source_file", "n", "c").dropDuplicates(["number", "source_file"])
    total = hit.groupBy("number").agg(F.sum("n").alias("nodes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("c"))
    return total.select("number", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("communities"), "nodes")


def conflicts(touched: DataFrame) -> DataFrame:
    """(community, prs) with several requests (number, community) on it."""
    return touched.distinct().groupBy("community").agg(F.count(F.lit(1)).alias("prs")).filter("prs > 1")


def blast_radius(nodes: Column, communities: Column) -> Column:
    """Short text of an impact."""
    s = lambda n, one, many: F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))
    return F.when(nodes > 0, F.concat(s(nodes, "node", "nodes"), F.lit(" / "), s(communities, "community", "communities"))).otherwise("")
