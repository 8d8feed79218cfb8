import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small fixture: clean texts, a bad one, copies and a contaminated text."""
    import random

    r = random.Random(1)
    vocab = [f"{a}{b}" for a in "th er on an re he".split() for b in "ing ed ion ly es or".split()]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bench = [(i, say(30)) for i in range(3)]
    rows, labels = [], []
    for i in range(240):
        good = i % 4 > 0
        text = say(40) if good else " ".join(w + "***" for w in say(40).split())
        rows.append((i, text, "en", "big" if i % 8 else "small", len(text)))
        labels.append((i, int(good), 0))
    clean = [x[0] for x in rows if x[0] % 4]
    copy = rows[1][1]
    rows += [(300, copy, "en", "big", 1), (301, copy + " more", "en", "big", 1), (302, say(10) + " " + bench[0][1] + " " + say(10), "en", "big", 1), (303, None, None, None, None)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, set(clean)


def test_stages(spark, folder):
    d, clean = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES[:4]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen[name] = {r[0] for r in docs.select("doc_id").collect()}
    assert clean <= seen["quality"] and not {i for i in range(240) if i % 4 == 0} & seen["quality"]
    assert clean <= seen["near_dedup"] and not {300, 301} & seen["near_dedup"]
    assert clean <= seen["decontamination"] and 302 not in seen["decontamination"]
    placed = C.STAGES[4][1](spark, docs, d)
    assert placed.count() == docs.count()


def test_run_and_empty_documents(spark, folder, tmp_path):
    d, _ = folder
    assert C.run(spark, d).filter("slot = 0").groupBy("shard").count().filter("count > 1").count() == 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_clashing_columns(spark, folder, tmp_path):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumns({"score": F.lit("x"), "mix_pass": F.lit(1), "contaminated": F.lit("y"), "_n": F.lit(2)})
    docs = docs.union(docs.filter("doc_id = 5"))
    for _, stage in C.STAGES[:4]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert docs.filter("doc_id = 5 AND score = 'x' AND mix_pass = 1").count() >= 1
    assert C.STAGES[4][1](spark, docs, d).count() == docs.count()


def test_rows_without_unique_ids(spark, folder):
    """Different texts under one id and rows without an id are documents of their own in every stage."""
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id < 240 AND doc_id % 4 > 0")
    texts = {r[0] for r in docs.select("text").collect()}
    for id_ in (None, 9):
        same = docs.withColumn("doc_id", F.lit(id_).cast("long"))
        assert {r[0] for r in C.near_dedup(spark, same, d).select("text").collect()} == texts
        assert {r[0] for r in C.decontamination(spark, same, d).select("text").collect()} == texts
        assert {r[0] for r in C.quality_filter(spark, same.union(docs), d).select("text").collect()} >= texts
        placed = C.sharding(spark, same, d)
        assert placed.count() == same.count()


def test_registry_names():
    assert sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for k in range(1, 11) for n in registry.QUERIES if n.startswith(f"op{k}_")]
    assert len(registry.QUERIES) == 10 and set(registry.SQL) <= set(registry.QUERIES)
