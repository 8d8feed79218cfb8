"""Change events: debounced sessions and incremental merges of the graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounce(events: DataFrame, key: str, time: str, path: str, gap: str = "3 seconds", watermark: str | None = None) -> DataFrame:
    """(key, started, changes, paths) of bursts with less than ``gap`` between changes.

    Works on batches and, with a ``watermark``, on streams, where a burst comes out once the
    watermark has passed its end.
    """
    e = events.withWatermark(time, watermark) if watermark else events
    by = e.groupBy(F.session_window(time, gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("changes"), F.array_sort(F.collect_set(path)).alias("paths"))
    return by.select(key, F.col("w.start").alias("started"), "changes", "paths")


def merge_into(path: str, nodes_of: Callable[[DataFrame], DataFrame], shrink: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts nodes into versions ``path/v=<batch>``.

    A version is written whole and then named in ``path/current``, so readers never see half of it;
    a batch that comes twice writes the same version again.  A version with fewer nodes than the one before
    is refused unless ``shrink``.
    """
    from ..operators.build import upsert_nodes

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = nodes_of(batch)
        try:
            now = spark.read.text(f"{path}/current").first()[0]
            old = spark.read.parquet(now)
            merged = upsert_nodes(old, new.select(*old.columns))
            if not shrink and merged.count() < old.count():
                raise ValueError("the new version has fewer nodes")
        except Exception as e:
            if isinstance(e, ValueError) or "PATH_NOT_FOUND" not in str(e):
                raise
            merged = upsert_nodes(new.limit(0), new)
        version = f"{path}/v={epoch}"
        merged.write.mode("overwrite").parquet(version)
        spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")

    return run


def current(spark, path: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{path}/current").first()[0])


def queue_pending(paths: DataFrame, folder: str) -> None:
    """Appends changed paths (ord, path) to a queue that any number of writers share."""
    paths.select("ord", "path").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{folder}/pending")


def drain_pending(spark, folder: str) -> DataFrame:
    """(ord, path) of the queue, each path once, in the order of its first coming; blank ones go.

    The queue is moved aside before it is read, so what comes later waits for the next drain.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    queue, aside = hadoop(f"{folder}/pending"), f"{folder}/drained-{uuid.uuid4().hex}"
    fs = queue.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    schema = "ord long, path string, at timestamp"
    if not fs.exists(queue) or not fs.rename(queue, hadoop(aside)):
        return spark.createDataFrame([], schema).select("ord", "path")
    rows = spark.read.schema(schema).parquet(aside).withColumn("path", F.trim("path")).filter("path <> ''")
    first = rows.groupBy("path").agg(F.min(F.struct("at", "ord")).alias("first"))
    return first.select((F.row_number().over(Window.orderBy("first", "path")) - 1).cast("long").alias("ord"), "path")  # one drain's changes


def event_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Extension: (started, event_type, events, total) in tumbling or sliding windows."""
    e = events.withWatermark("ts", watermark) if events.isStreaming else events
    by = e.groupBy(F.window("ts", window, slide) if slide else F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("total"))
    return by.select(F.col("window.start").alias("started"), "event_type", "events", "total")
