"""Benchmark decontamination by SimHash of item-sized windows, with a multi-index join and exact verification.

DataFrame functions only. Words are runs without blanks, lower-cased; a shingle is five words; an item of n words is the
multiset of its n - 4 shingles. A document leaks an item when one of its windows of as many shingles (the whole document
if it is shorter) has a weighted Jaccard similarity, sum of smaller counts by sum of larger counts, of at least
``threshold``.

* *Windows*: a window that similar must hold one of the item's first shingles in order of rarity whose counts exceed
  ``1 - threshold`` of it. Around these, every window is considered that begins with one of the item's shingles (or
  ends with the document) and whose places with the item's shingles suffice. No other window holds more of the item: one
  that begins with a foreign shingle loses nothing by moving on. Of two that follow each other the second is left out if
  what it has beyond the first is all foreign. Clean text makes no window at all.
* *Multi-index*: distinct windows and items get a 64-bit SimHash, cut into ``radius + 1`` blocks. Two fingerprints
  within ``radius`` agree in one block at least, so that the join on (item, block, value) finds all of them; the item is
  the one whose rare shingle the window holds, as every window that similar to it does. At a similarity of 0.8 a pair
  differs in 10 of 64 bits on average; how many pairs 19 leaves out is measured in the tests.
* *Verification*: pairs within the radius are compared shingle by shingle.

One row per (document, item) found. Defined cases: null text counts as empty; items of fewer than five words and
documents of fewer than five words have no shingle and match nothing; repeated rows give one result; a null ``doc_id``
is kept and told apart by its text; repeated items are items of their own; extra columns are ignored; empty tables give
an empty result; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small, stored, table, text_or_empty, without

WORDS = 5
THRESHOLD = 0.8
RADIUS = 19

_FINGERPRINT = (
    "aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft(cast(2 * aggregate(s, 0, (a, x) -> a + cast(shiftrightunsigned(x, b) & 1 as int)) > size(s) as bigint), b))"
)


def shingled(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the hashes of the shingles in order.

    The words are a column of their own, made once for each row. A filter on the result, which explode() brings along
    and explode_outer() doesn't, would be pushed down with the words made anew for each shingle."""
    words = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")
    heads = F.slice("_words", 1, F.greatest(F.size("_words") - (WORDS - 1), F.lit(0)))
    made = F.transform(heads, lambda w, i: F.xxhash64(w, *(F.get("_words", i + k) for k in range(1, WORDS))))
    return df.withColumn("_words", words).withColumn(name, made).drop("_words")


def _blocks(radius: int) -> Column:
    """array<struct<block, value>> of column ``f``: 64 bits in radius + 1 blocks."""
    n = radius + 1
    edges = [round(64 * k / n) for k in range(n + 1)]
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("f", a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint")).alias("value")) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, m, t): items with their number of shingles and the shingles."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), text_or_empty().alias("text"))
    items = shingled(items, F.col("text"), "t").select("item_id", "t", F.size("t").alias("m"), F.monotonically_increasing_id().alias("item"))
    return items


def _anchors(items: DataFrame, threshold: float) -> DataFrame:
    """(h, item): the prefix shingles of items."""
    each = items.select("item", "m", F.explode("t").alias("h"))
    counted = each.groupBy("item", "m", "h").agg(F.count("*").alias("n"))
    known = counted.join(counted.groupBy("h").agg(F.count("*").alias("df")), "h")
    order = Window.partitionBy("item").orderBy("df", "h").rowsBetween(Window.unboundedPreceding, -1)
    need = F.col("m") - F.ceil(F.lit(threshold) * F.col("m") - 1e-9) + 1
    prefix = known.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).filter(F.col("before") < need)
    return prefix.select("h", "item")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, item_id, word_start, n_words, similarity, hamming, n_windows) of each leaked item of each document."""
    items = stored(_items(benchmark), "leak-items").filter("m > 0")
    anchors = stored(_anchors(items, threshold), "leak-anchors")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    hashed = shingled(rows, F.col("text"), "h").select("doc_id", "text_hash", "h")
    each = hashed.select("doc_id", "text_hash", F.size("h").alias("size"), F.posexplode_outer("h").alias("at", "h"))
    met = each.join(small(anchors), "h")
    met = met.groupBy("doc_id", "text_hash", "item").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    met = met.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item", "first", "last")).alias("near"))
    met = stored(met.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "near"), "leak-places")
    some = rows.join(small(met), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")))
    some = shingled(some, F.col("text"), "h").select("doc_id", "text_hash", "h", F.explode_outer("near").alias("n")).select("doc_id", "text_hash", "h", "n.*")
    some = some.join(small(items), "item").select("doc_id", "text_hash", "item", "h", "m", "t", "first", "last")
    # places of the item's shingles in all windows that hold a place from first to last
    low = F.greatest(F.col("first") - F.col("m") + 1, F.lit(0))
    some = some.withColumn("low", low).withColumn("met", F.slice("h", F.col("low") + 1, F.col("last") + F.col("m") - F.col("low")))
    some = some.withColumn("places", F.filter(F.transform("met", lambda x, i: F.when(F.array_contains("t", x), F.col("low") + i)), lambda p: p.isNotNull()))
    some = some.filter(F.size("places") >= F.ceil(F.lit(threshold) * F.col("m") - 1e-9))
    some = some.withColumn("starts", F.array_sort(F.array_distinct(F.transform("places", lambda p: F.greatest(F.least(p, F.size("h") - F.col("m")), F.lit(0))))))
    within = lambda a, b: F.filter("places", lambda p: (p >= a) & (p < b))
    more = lambda s, k: (k == 0) | (F.size(within(F.get("starts", k - 1) + F.col("m"), s + F.col("m"))) > 0)
    enough = lambda s: F.size(within(s, s + F.col("m"))) >= F.ceil(F.lit(threshold) * F.col("m") - 1e-9)
    some = some.withColumn("starts", F.filter("starts", lambda s, k: more(s, k) & enough(s)))
    cut = F.transform("starts", lambda a: F.struct(a.alias("start"), F.col("m").alias("m"), F.slice("h", a + 1, F.least(F.col("m"), F.size("h"))).alias("s")))
    windows = some.select("doc_id", "text_hash", "item", F.explode_outer(cut).alias("w")).select("doc_id", "text_hash", "item", "w.*").filter("start is not null")
    windows = stored(windows.withColumn("key", F.sha2(F.concat_ws(",", "m", F.array_join(F.transform("s", lambda x: x.cast("string")), ",")), 256)), "leak-windows")

    # copies of a passage have equal windows: each is compared once
    distinct = windows.groupBy("item", "key", "m").agg(F.first("s").alias("s"))
    marked = distinct.withColumn("f", F.expr(_FINGERPRINT)).select("item", "key", "f", F.explode(_blocks(radius)).alias("b")).select("item", "key", "f", "b.*")
    targets = items.withColumn("s", F.col("t")).withColumn("f", F.expr(_FINGERPRINT)).select("item", F.col("f").alias("g"), F.explode(_blocks(radius)).alias("b")).select("item", "g", "b.*")
    # blocks of three or four bits agree by chance; the item, by a shingle of which each window was made, keeps candidates few
    near = marked.join(targets, ["item", "block", "value"]).withColumn("hamming", F.bit_count(F.col("f").bitwiseXOR(F.col("g")))).filter(F.col("hamming") <= radius)
    near = near.select("key", "item", "hamming").distinct()
    pairs = near.join(distinct, ["item", "key"]).join(items.select("item", "item_id", "t"), "item")
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_distinct("t"), F.lit(0), lambda a, x: a + F.least(count(F.col("s"), x), count(F.col("t"), x)))
    pairs = pairs.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("s") + F.size("t") - F.col("shared")))
    pairs = pairs.filter(F.col("similarity") >= threshold - 1e-12).select("item", "key", "item_id", "hamming", "similarity", (F.size("s") + WORDS - 1).cast("bigint").alias("n_words"))
    found = windows.select("doc_id", "text_hash", "start", "item", "key").join(pairs, ["item", "key"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "n_words", "hamming")).alias("best")
    found = found.groupBy("doc_id", "text_hash", "item_id").agg(best, F.count_distinct("start").alias("n_windows"))
    return found.select("doc_id", "text_hash", "item_id", (-F.col("best.start")).cast("bigint").alias("word_start"), "best.n_words", "best.similarity", "best.hamming", "n_windows")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item, all columns."""
    found = stored(leaks(docs, benchmark).select("doc_id", "text_hash").distinct(), "leak-decisions")
    return without(docs, found, F.xxhash64(text_or_empty()))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
