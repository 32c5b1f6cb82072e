"""Exact dedup by a log-structured merge index of text digests.

Two texts are equal when they are identical after every run of blanks (``[\\x20\\x09-\\x0D]+``) is replaced by one space.

* *Memtables*: each task gathers (digest, smallest row, count) until ``memtable_rows`` digests, then flushes them as a
  run sorted by digest. Runs are Parquet files with a Bloom filter for each row group, so that ``DigestIndex.lookup``
  of a few digests skips the runs that can't hold them.
* *Compaction* merges the runs of a level: the smallest identifier stays and counts add up. Runs hold a digest once,
  so even a text that a third of all rows repeat arrives at the merge as one row per run.
* *Byte verification*: every row that hits a digest seen before is compared, as text, with the row that stays. Hits of
  one digest are dealt over as many tasks as their number asks for. Rows that differ (a digest collision) are grouped
  by their text itself.

Defined cases: null text counts as empty; empty texts equal each other; a null ``doc_id`` sorts after all others (if
all are null, ``keep_id`` is null); of rows repeated with the same id and text exactly one stays; extra columns are
ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import one_each, scratch, small, stored, table, text_or_empty, without

#: Blanks that need a change: longer runs, or one that isn't a space.
_BLANKS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
#: Hits of one digest that one task verifies.
_HITS_PER_TASK = 2000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, _BLANKS, " ")


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Runs of (digest, id, row, n) in ``path``, one folder per level."""

    def __init__(self, spark: SparkSession, path: str | None = None, memtable_rows: int = 200_000):
        self.spark, self.path, self.memtable_rows = spark, path or scratch(spark, "digest-index"), memtable_rows

    def _write(self, runs: DataFrame, level: int) -> DataFrame:
        at = f"{self.path}/level={level}"
        runs.write.mode("append").option("parquet.bloom.filter.enabled#digest", "true").parquet(at)
        return self.spark.read.schema(runs.schema).parquet(at)

    def ingest(self, keys: DataFrame) -> DataFrame:
        """Adds the rows (digest, doc_id, rid) as runs of level 0."""
        most = self.memtable_rows

        def merged(tables: list[pd.DataFrame]) -> pd.DataFrame:
            held = pd.concat(tables).sort_values(["digest", "doc_id", "rid"], na_position="last", kind="stable")
            n = held.groupby("digest", sort=False)["n"].transform("sum")
            return held.assign(n=n).drop_duplicates("digest")

        def memtables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            waiting = 0
            for batch in batches:
                held.append(batch.assign(n=1, doc_id=batch["doc_id"].astype("Int64")))
                waiting += len(batch)
                if waiting > most:
                    held = [merged(held)]
                    waiting = len(held[0])
                    if waiting > most // 2:
                        yield held.pop()
                        waiting = 0
            if held:
                yield merged(held)

        return self._write(keys.mapInPandas(memtables, "digest binary, doc_id bigint, rid bigint, n bigint"), 0)

    def compact(self, runs: DataFrame, level: int = 1) -> DataFrame:
        """The runs merged: one row per digest with the smallest (id, row) and the summed count."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid"))
        merged = runs.groupBy("digest").agg(first.alias("first"), F.sum("n").alias("n"))
        merged = merged.select("digest", F.col("first.doc_id").alias("doc_id"), F.col("first.rid").alias("rid"), "n")
        return self._write(merged.sortWithinPartitions("digest"), level)

    def lookup(self, digests: list[bytes], level: int = 1) -> DataFrame:
        """The entries of a few digests; row groups whose filter excludes them aren't read."""
        return self.spark.read.parquet(f"{self.path}/level={level}").filter(F.col("digest").isin(digests))


def exact_dedup(docs: DataFrame, memtable_rows: int = 200_000, digest=sha256_of) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, digest."""
    spark = docs.sparkSession
    text = normalised(text_or_empty())
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("norm"))
    keys = texts.select("doc_id", digest(F.col("norm")).alias("digest"), F.sha2("norm", 256).alias("text_sha256"))
    keys = stored(keys.withColumn("text_sha256", F.unhex("text_sha256")).withColumn("rid", F.monotonically_increasing_id()), "dedup-keys")
    index = DigestIndex(spark, memtable_rows=memtable_rows)
    entries = index.compact(index.ingest(keys.select("digest", "doc_id", "rid")))
    repeated = entries.filter("n > 1").select("digest", F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid"), F.col("n").alias("group_size"))

    # byte verification of the hits
    tasks = F.ceil(F.col("group_size") / _HITS_PER_TASK).cast("bigint")
    hits = texts.withColumn("digest", digest(F.col("norm"))).join(small(repeated), "digest").withColumn("tasks", tasks)
    keeps = hits.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "tasks").agg(F.min("norm").alias("kept_norm"))
    keeps = keeps.select("digest", "kept_norm", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)).alias("task"))
    hits = hits.withColumn("task", F.pmod(F.monotonically_increasing_id(), F.col("tasks")))
    strangers = stored(
        hits.join(keeps, ["digest", "task"]).filter("norm <> kept_norm").select("doc_id", "digest", F.unhex(F.sha2("norm", 256)).alias("text_sha256"), F.sha2("norm", 512).alias("second")),
        "dedup-strangers",
    )

    out = keys.join(small(repeated), "digest", "left")
    out = out.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
        "digest",
        "rid",
    )
    if not strangers.isEmpty():
        # texts that share a digest: these groups are made anew by a second digest beside the full one
        again = out.join(strangers.select("digest").distinct(), "digest", "left_semi")
        texts2 = again.groupBy("digest", "text_sha256").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("first"), F.count("*").alias("size"))
        again = again.drop("keep_id", "group_size", "kept").join(texts2, ["digest", "text_sha256"])
        again = again.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256", "digest", "rid")
        out = out.join(strangers.select("digest").distinct(), "digest", "left_anti").select(again.columns).unionByName(again)
    return out.drop("rid")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns."""
    found = stored(exact_dedup(docs).select("doc_id", "text_sha256", "kept"), "dedup-decisions")
    per_key = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("any_kept"), F.count("*").alias("rows"))
    odd = stored(per_key.filter("not any_kept or rows > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "any_kept", "rows"), "dedup-drops")
    gone, ties = odd.filter("not any_kept"), odd.filter("any_kept")
    key = F.sha2(normalised(text_or_empty()), 256)
    if ties.isEmpty():
        return without(docs, gone.select("_id", "_sha"), key)
    return without(docs, odd.select("_id", "_sha"), key).unionByName(one_each(without(docs, ties.select("_id", "_sha"), key, "left_semi"), key))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
