"""Mixing sources to target weights by packed blocks and pseudorandom index permutations.

* *Packing*: the words of a source, in a fixed order of its rows, form one stream that is cut into blocks of
  ``block_words`` words. A row's place in the stream comes from a prefix sum in two steps (chunks of rows, then rows
  of a chunk), so that a source with a third of all rows is no single task.
* *Draw*: the output is made of shards of ``shard_slots`` block slots. For each shard the counts of its sources are a
  seeded multinomial draw: the whole part of each expectation is fixed and the slots left are drawn by what remains
  (the residual form of the multinomial, same mean, less variance).
* *Permutation*: the j-th slot of a source takes block perm(j mod blocks), with a keyed Feistel permutation of its own
  for each source and pass; no shuffle buffer exists anywhere.
* *Join by index*: slots meet blocks on (source, block).

Sources are ordered by code point, null last, and weigh 1, 2, 3, repeating. Targets share all words by weight, and
stop at ``most_repeats`` times a source's size; the excess is shared by weight among the others.

Defined cases: null text has size 0; documents without words are in no block and taken 0 times; an empty table gives
an empty mix; rows repeated with the same id and text are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small, stored, table, text_or_empty

_WORD = r"[^\x20\x09-\x0D]+"
#: Least number of rows whose prefix sum one task makes; with more rows, their square root: chunks and rows of a chunk grow alike.
_CHUNK_ROWS = 2_000


def source_targets(sizes: DataFrame, most_repeats: float = 3.0) -> DataFrame:
    """One row per source: sid, source, source_size, target. ``sizes``: (source, size); windows see a row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    # a bigint like that of the slots: a cast in their join would hide that blocks are already dealt by (sid, block)
    per = per.withColumn("sid", (F.row_number().over(by_name) - 1).cast("bigint")).withColumn("weight", (F.col("sid") % 3 + 1).cast("double"))
    per = per.withColumn("cap", most_repeats * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("level", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # sources in order of cap/weight are capped up to the first that the common level doesn't reach
    capped = F.col("cap") < F.col("weight") * F.col("level")
    level = F.min(F.when(~capped, F.struct(F.col("cap") / F.col("weight"), F.col("sid"), F.col("level")))).over(everything)
    per = per.withColumn("final", level["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("final")))
    return per.select("sid", "source", "source_size", target.alias("target"))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of range(size) for each entry: four Feistel rounds over the next even power of two, walked until in range."""
    size = np.maximum(size.astype(np.uint64), 1)
    half = np.ceil(np.log2(np.maximum(size, 2).astype(np.float64)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for turn in range(4):
            z = (right + k + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


class Mix:
    """The plan of a mix of ``docs``; its tables are in the shared folder."""

    def __init__(self, docs: DataFrame, block_words: int = 64, shard_slots: int = 65_536, most_repeats: int = 3, seed: int = 7):
        spark = docs.sparkSession
        self.block_words, self.most_repeats, self.seed = block_words, most_repeats, seed
        size = F.regexp_count(text_or_empty(), F.lit(_WORD)).cast("bigint")
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("text_hash"))
        rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "mix-rows")
        self.sources = stored(source_targets(rows, most_repeats), "mix-sources")
        known = self.sources.select("sid", F.col("source").alias("name"), "source_size", "target")
        n_sources = known.count()

        # places in the stream: chunks first, then the rows of a chunk
        n_rows = rows.count()
        chunks = max(1, -(-n_rows // max(_CHUNK_ROWS, math.isqrt(n_rows))))
        rows = rows.join(small(known), rows["source"].eqNullSafe(known["name"])).drop("name")
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(chunks)))
        totals = rows.groupBy("sid", "chunk").agg(F.sum("size").alias("n"))
        before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        within = Window.partitionBy("sid", "chunk").orderBy("doc_id", "text_hash", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        self.rows = stored(rows.join(totals, ["sid", "chunk"]).withColumn("start", F.col("base") + F.col("inner")).drop("chunk", "inner", "base"), "mix-places")
        self.slots = stored(self._slots(spark, known, shard_slots), "mix-slots")

    def _slots(self, spark: SparkSession, known: DataFrame, shard_slots: int) -> DataFrame:
        """(shard, slot, sid, block). The source table, one row per source, is the multinomial's parameter and goes to every task."""
        of = known.orderBy("sid").toPandas()
        words = of["source_size"].to_numpy(np.float64)
        blocks = np.ceil(words / self.block_words).astype(np.int64)
        expected = np.divide(of["target"].to_numpy(np.float64) * blocks, words, out=np.zeros(len(words)), where=words > 0)
        total = int(round(expected.sum()))
        share = expected / expected.sum() if total else expected
        shards, seed, most = -(-total // shard_slots), self.seed, self.most_repeats

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for shard in batch["id"]:
                    n = min(shard_slots, total - shard * shard_slots)
                    fixed = np.floor(share * n).astype(np.int64)
                    rest = share * n - fixed
                    drawn = fixed
                    if (left := n - fixed.sum()) > 0:
                        chance = rest / rest.sum() if rest.sum() > 0 else share
                        drawn = fixed + np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(left, chance)
                    sid = np.flatnonzero(drawn)
                    yield pd.DataFrame({"shard": shard, "sid": sid, "n": drawn[sid]})

        counts = spark.range(0, shards, 1, max(1, min(shards, 4096))).mapInPandas(draw, "shard bigint, sid bigint, n bigint")
        counts = stored(counts, "mix-counts")
        before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        in_shard = Window.partitionBy("shard").orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("slot", F.coalesce(F.sum("n").over(in_shard), F.lit(0)))

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for shard, sid, n, first, slot in zip(*(batch[c].to_numpy() for c in ("shard", "sid", "n", "first", "slot")), strict=True):
                    # a block serves at most most_repeats slots; what residual draws give beyond is left out
                    j = np.arange(first, min(first + n, most * blocks[sid]), dtype=np.int64)
                    key = np.uint64((seed * 1_000_003 + int(sid)) * 0x9E3779B97F4A7C15 % 2**64) ^ ((j // blocks[sid]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                    yield pd.DataFrame({"shard": shard, "slot": slot + np.arange(len(j)), "sid": sid, "block": permuted(j % blocks[sid], np.full(len(j), blocks[sid]), key)})

        counts = counts.repartition(max(1, min(4 * shards, 4096)), "shard", "sid") if shards else counts
        return counts.mapInPandas(fill, "shard bigint, slot bigint, sid bigint, block bigint")

    def pieces(self) -> DataFrame:
        """(rid, sid, block, skip, n): which words of a row are in which block."""
        w = self.block_words
        rows = self.rows.filter("size > 0")
        first, last = F.floor(F.col("start") / w), F.floor((F.col("start") + F.col("size") - 1) / w)
        out = rows.select("rid", "sid", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        begin = F.greatest(F.col("start"), F.col("block") * w)
        return out.select("rid", "sid", "block", (begin - F.col("start")).alias("skip"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * w) - begin).alias("n"))

    def taken(self) -> DataFrame:
        """(rid, taken): words that the mix takes of each row, repeats counted."""
        uses = self.slots.groupBy("sid", "block").agg(F.count("*").alias("uses"))
        return self.pieces().join(uses, ["sid", "block"]).groupBy("rid").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))

    def digest(self) -> DataFrame:
        out = self.rows.join(self.taken(), "rid", "left")
        return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))

    def blocks(self, docs: DataFrame) -> DataFrame:
        """The mix itself, one row per slot: shard, slot, source, block, doc_ids, n_words, text (words joined by spaces)."""
        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("source"), text_or_empty().alias("text"))
        places = self.rows.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("source").alias("src"), "start", "sid", "size").filter("size > 0")
        places = places.withColumn("equal", F.count("*").over(Window.partitionBy("id", "hash", "src")))
        places = stored(places, "mix-texts")
        single, tied = places.filter("equal = 1"), places.filter("equal > 1")
        on = lambda t, p: t["doc_id"].eqNullSafe(p["id"]) & (t["text_hash"] == p["hash"]) & t["source"].eqNullSafe(p["src"])
        both = texts.join(single, on(texts, single))
        if not tied.isEmpty():  # rows repeated with the same id and text: each place needs one of them
            some = tied.select("id", "hash", "src").distinct()
            one = texts.join(small(some), on(texts, some), "left_semi").dropDuplicates(["doc_id", "text_hash", "source"])
            both = both.unionByName(one.join(tied, on(one, tied)))
        w = self.block_words
        words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
        both = both.select("doc_id", "sid", "start", "size", words.alias("words"))
        first, last = F.floor(F.col("start") / w), F.floor((F.col("start") + F.col("size") - 1) / w)

        def piece(block):
            begin = F.greatest(F.col("start"), block * w)
            end = F.least(F.col("start") + F.col("size"), (block + 1) * w)
            return F.struct(block.alias("block"), begin.alias("begin"), (end - begin).alias("n"), F.array_join(F.slice("words", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int")), " ").alias("text"))

        cut = both.select("doc_id", "sid", F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select("doc_id", "sid", "p.*")
        packed = cut.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("begin", "doc_id", "n", "text"))).alias("parts"))
        packed = packed.select("sid", "block", F.col("parts.doc_id").alias("doc_ids"), F.aggregate("parts.n", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_words"), F.array_join("parts.text", " ").alias("text"))
        names = self.sources.select("sid", "source")
        out = self.slots.join(packed, ["sid", "block"]).join(small(names), "sid")
        return out.select("shard", "slot", "source", "block", "doc_ids", "n_words", "text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).digest()
