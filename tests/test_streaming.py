import datetime as dt

from pyspark.sql import functions as F

from weftgraph.streaming import watch

S = "path string, ts timestamp, repo string"


def at(s):
    return dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)


def test_debounce_batch(spark):
    e = spark.createDataFrame([("a", at(0), "r"), ("b", at(2), "r"), ("a", at(4), "r"), ("c", at(10), "r")], S)
    got = sorted((r["changes"], r["paths"]) for r in watch.debounce(e, "repo", "ts", "path").collect())
    assert got == [(1, ["c"]), (3, ["a", "b"])]


def test_debounce_stream_and_merge(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "graph")
    spark.createDataFrame([("a", at(0), "r"), ("b", at(1), "r"), ("c", at(600), "r")], S).write.parquet(src)
    stream = spark.readStream.schema(S).parquet(src)
    q = watch.debounce(stream, "repo", "ts", "path", watermark="1 minute").writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["changes"], r["paths"]) for r in spark.table("bursts").collect()] == [(2, ["a", "b"])]

    def nodes(batch):
        return batch.groupBy(F.col("path").alias("id")).agg(F.max("repo").alias("label"), F.lit(0).cast("long").alias("ord"))

    for step in (1, 2):
        run = watch.merge_into(out, nodes)
        q = spark.readStream.schema(S).parquet(src).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(r["id"] for r in watch.current(spark, out).collect()) == ["a", "b", "c"] + ["d"] * (step - 1)
        spark.createDataFrame([("d", at(700), "r2"), ("a", at(701), "r3")], S).write.mode("append").parquet(src)
    run(spark.createDataFrame([("a", at(1), "r9")], S), 5)
    assert dict(watch.current(spark, out).select("id", "label").collect())["a"] == "r9"


def test_windows(spark):
    e = spark.createDataFrame([(at(0), "x", 1.0), (at(30), "x", 2.0), (at(4000), "x", 4.0)], "ts timestamp, event_type string, value double")
    assert sorted(r["total"] for r in watch.event_counts(e).collect()) == [3.0, 4.0]
    assert watch.event_counts(e, "1 hour", "30 minutes").count() == 4
