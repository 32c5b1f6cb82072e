"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import scratch, table
from tidemark.llm.decontaminate import drop_leaks
from tidemark.llm.exact_dedup import drop_copies
from tidemark.llm.mixing import Mix
from tidemark.llm.ngram_join import drop_similar
from tidemark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the labelled ones, doesn't reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, one row per slot: shard, slot, source, block, doc_ids, n_words, text."""
    return Mix(docs).blocks(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("mixing", mixing)]

#: The classifier and the join are no SQL; each stage is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
    return docs
