"""A training-corpus pipeline: STAGES in order, each applied to the whole of what the stage before it kept.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame``. All but the last return the columns of ``documents``;
the last adds ``size``, ``text_crc32``, ``shard`` and ``slot``. Edge cases (nulls, empty and very long texts, repeated
rows, empty tables) are those of the operators; a stage never drops a row for them: a document without words, or
without an id, is neither toxic nor a copy nor leaked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm import decontamination, toxicity
from gridwright.llm.mixing import mixed_documents
from gridwright.llm.ngram_join import without_near_copies
from gridwright.llm.sharding import shard

TOXIC = 0.7
SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the model learns from the labelled ones outside the held-out third.

    Null and empty texts score as texts without hits and stay; repeated rows and null ids stay or go by their text
    alone. Without labels of both kinds all documents have the same score; an empty table stays empty.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs, score_col="_toxic").where(F.col("_toxic") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8): the one with the smallest id.

    Rows with equal ids in one group are copies, too: one of them stays. In different groups they are different
    documents and all stay, as do rows without words or without an id.
    """
    return without_near_copies(docs, k=5, similarity="0.8")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, whatever their ids; repeated rows stay or go together. Null or wordless
    items are left out, and without items, or documents, the table comes back as it is.
    """
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by weights 1, 2, 3 takes them, not at all if it takes half of their words or less.

    Documents without words, null texts too, are passed on once. A null source is one like others. Rows of one id,
    source and text are one document whose repetitions add up. An empty table stays empty.
    """
    return mixed_documents(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it.

    Null texts are a group of their own; repeated rows and null ids count as rows. With fewer groups than shards some
    shards are empty; an empty table stays empty.
    """
    return shard(docs, SHARDS)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("sharding", into_shards)]

#: No stage but the last could be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder and read again."""
    from gridwright.llm.common import keep

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, f"stage-{name}")
    return docs
