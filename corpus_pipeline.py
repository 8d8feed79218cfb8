"""Corpus pipeline: from raw documents to training shards.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; the
rows of a stage are written and read again before the next.  All but the last
return the columns of ``documents``; the last places every row in a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, mix, neardup, quality, shard
from weftgraph.llm.common import discard, settled, table

#: Prefix of the columns that operators add on the way, clear of those of ``documents``.
OWN = "_weft_"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1.

    Null and empty texts are scored like any text, by what they share with labelled ones; where no label can be
    learned from, all stay.
    """
    model = quality.model_of(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model, prefix=OWN).filter(F.col(f"{OWN}predicted") == 1).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (5-word shingles, similarity 0.8).

    A document is known by its id and text: different texts under one id are different documents, and
    those with a null id are members of groups too.  Of repeated rows one stays; documents without words all stay.
    """
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), prefix=OWN)
    return judged.filter(~F.col(f"{OWN}contaminated")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or cut so that sources have their temperature weights."""
    return mix.mix_documents(docs, prefix=OWN).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row, in 40 shards of near equal bytes."""
    return shard.shard_documents(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # the tables of the input are never ours to remove
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, min-max hashing and the k-d tree have no SQL form.
ORACLE_SQL = None
