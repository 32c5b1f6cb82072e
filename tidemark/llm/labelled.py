"""Labelled rows for the classifiers: which rows may teach, and a bounded sample of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows with crc32(doc_id as text) mod 5 = 0 never teach."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def teaching_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, whole: bool = False, balanced: bool = False) -> pd.DataFrame:
    """About ``rows`` labelled, not held out rows as (text, label, weight), each text cut to ``chars`` code points; ordered by hash.
    With ``whole``, of these rows the ones whose text isn't longer; with ``balanced``, about half of each label as far as
    there are as many. ``weight``: how many labelled rows of its label a row stands for.

    The rows are those with the smallest hashes of doc_id, so that the sample doesn't depend on order or partitions."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    there = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    few = min(there.values(), default=0)
    share = {k: min(1.0, (max(rows - few, rows / 2) if n > few else rows / 2) / n) if balanced else min(1.0, rows / sum(there.values())) for k, n in there.items()}
    known = known.withColumn("order", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    for k, part in share.items():
        if part < 1:
            known = known.filter((F.col("label") != k) | (F.col("order") < int((1 << 30) * part)))
    # bounded by ``rows`` whatever the input
    texts = docs.filter(F.length("text") <= chars) if whole else docs
    texts = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text"))
    found = texts.join(F.broadcast(known), "doc_id").select("text", "label", "order", "doc_id").toPandas()
    found = found.sort_values(["order", "doc_id", "text"], kind="stable", ignore_index=True)[["text", "label"]]
    return found.assign(weight=found["label"].map({k: 1 / v for k, v in share.items()}).astype(float))
