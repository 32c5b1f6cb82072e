"""Target-distribution importance resampling: hashed word runs weigh documents by how much likelier the target makes them; the best scores are drawn.

* *Weights*: features are runs of one to three words, hashed into ``BUCKETS`` buckets. Counts of both sides are arrays added up in tasks,
  then by bucket; the gains, one array of that length, go to every task. A text's bytes are hashed on from word to word, so that a
  feature costs one short step, and long texts are read in pieces.
* *Runs*: scores of eligible documents, with what breaks ties, are sorted in every task into runs that are stored in blocks.
* *Merge*: bins of the order, with borders from a sample of block heads, are merged each by a tournament tree over the runs' open blocks; a
  block is opened only when the tree comes to its head. Exact counts of the bins tell each its first rank, which bins
  are needed, and where the last one stops: the draw is exact, ranks need no pass over a whole, and a bin's task holds the open blocks only.

The order is total (score, doc_id with nulls last, n_features, row), so that a doc_id with a third of all rows is split like any other rows.
The sample decides how even bins are, nothing else.

Defined cases: null and empty texts have no feature and weight 0; a null doc_id hashes as empty text and ranks after others of equal score;
repeated rows each have a row and, if drawn, a rank of their own; an empty table gives an empty result, an empty target weighs by
the documents alone; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

# fixed values
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42

_WORD_BYTES = bytes(range(ord("0"), ord("9") + 1)) + bytes(range(ord("a"), ord("z") + 1)) + bytes(range(128, 256))
#: A-Z to a-z, what is in no word to a blank.
_TO = bytes(b if b in _WORD_BYTES else b + 32 if ord("A") <= b <= ord("Z") else 32 for b in range(256))
_KEY = ("score", "unknown", "doc_id", "n_features", "rid")


def _pieces(blob: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece."""
    at = 0
    while at < len(blob):
        end = _border(blob, at + size)
        yield blob[at:end].translate(_TO).split()
        at = end


def _border(blob: bytes, at: int) -> int:
    """The first place from ``at`` on that is in no word."""
    while at < len(blob) and _TO[blob[at]] != 32:
        at += 1
    return min(at, len(blob))


def feature_buckets(text: str | None, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of a text's features, and before each array the number of new words, as its first entry."""
    tail: list[bytes] = []
    for words in _pieces((text or "").encode()):
        if not words:
            continue
        old, words = len(tail), tail + words
        spaced = [b" " + w for w in words[1:]]
        one = list(map(zlib.crc32, words))
        two = list(map(zlib.crc32, spaced, one))
        three = list(map(zlib.crc32, spaced[1:], two))
        # runs that end in a word of this piece; the last words of the one before only begin them
        found = np.fromiter((x for part, n in ((one, 1), (two, 2), (three, 3)) for x in part[max(0, old - n + 1) :]), np.int64)
        yield np.concatenate([[len(words) - old], found % buckets])
        tail = words[-2:]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all of ``texts`` (text) are in each bucket; the driver gets one number a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found in feature_buckets(text.as_py(), buckets):
                    total += np.bincount(found[1:], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier the target makes each bucket, rounded down; one is added to each count."""
    n, total, aim = len(source), float(source.sum()), float(target.sum())
    return np.floor(1000 * np.log((target + 1.0) * (total + n) / ((source + 1.0) * (aim + n)))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: rid, doc_id, n_features, n_words, weight, score, eligible."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for k, text in enumerate(batch.column(1)):
                for found in feature_buckets(text.as_py(), len(gain)):
                    out[:, k] += len(found) - 1, found[0], gain[found[1:]].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["doc_id", "n_features", "n_words", "weight"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(weigh, "doc_id bigint, n_features bigint, n_words bigint, weight bigint")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.ln(-F.ln((drawn + 0.5) / F.lit(4294967296.0))))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "*", (F.col("weight") + noise).cast("bigint").alias("score"), (F.col("n_words") >= least_words).alias("eligible"))


class TournamentTree:
    """Winners of pairs up to the root, over leaves that may change one at a time; the least key wins."""

    def __init__(self, leaves: int = 2):
        self.size, self.keys = leaves, [None] * leaves
        self.winner = [0] * leaves

    def _better(self, a: int, b: int) -> int:
        x, y = self.keys[a], self.keys[b]
        return a if y is None or x is not None and x <= y else b

    def put(self, leaf: int, key: tuple | None) -> None:
        """Sets a leaf's key (None: nothing left) and replays its matches."""
        while leaf >= self.size:
            self._grow()
        self.keys[leaf] = key
        self._replay(leaf)

    def _replay(self, leaf: int) -> None:
        node = (leaf + self.size) // 2
        while node:
            left, right = 2 * node, 2 * node + 1
            a = left - self.size if left >= self.size else self.winner[left]
            b = right - self.size if right >= self.size else self.winner[right]
            self.winner[node] = self._better(a, b)
            node //= 2

    def _grow(self) -> None:
        self.keys += [None] * self.size
        self.size *= 2
        self.winner = [0] * self.size
        for leaf in range(0, self.size, 2):
            self._replay(leaf)

    def best(self) -> tuple[int, tuple | None]:
        leaf = self.winner[1]
        return leaf, self.keys[leaf]


def merge_runs(blocks: Iterator[list[tuple]]) -> Iterator[tuple]:
    """All keys in order, from sorted blocks that come in the order of their heads. A block is read only when the tree has come to its head."""
    tree, held, free = TournamentTree(), {}, []
    following = next(blocks, None)
    while True:
        leaf, key = tree.best()
        if following is not None and (key is None or following[0] <= key):
            leaf = free.pop() if free else len(held)
            held[leaf] = iter(following)
            tree.put(leaf, next(held[leaf]))
            following = next(blocks, None)
        elif key is None:
            return
        else:
            yield key
            after = next(held[leaf], None)
            tree.put(leaf, after)
            if after is None:
                held[leaf] = None
                free.append(leaf)


_BLOCK = "run bigint, block bigint, n bigint, " + ", ".join(f"{c} array<bigint>" for c in _KEY)


def _keys(row: dict) -> list[tuple]:
    return list(zip(*(row[c] for c in _KEY), strict=True))


def _block_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """rows: leading numbers, then a list of keys."""
    n = len(names) - len(_KEY)
    cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(n)]
    cols += [pa.array([[key[k] for key in r[n]] for r in rows], pa.list_(pa.int64())) for k in range(len(_KEY))]
    return pa.RecordBatch.from_arrays(cols, names)


def sorted_runs(rows: DataFrame, run_rows: int = 1 << 17, block_rows: int = 1 << 10) -> DataFrame:
    """Eligible rows of ``scored`` as sorted runs of at most ``run_rows`` keys, in blocks: run, block, n and the key's columns (score negated) as arrays."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, n = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            cols = np.concatenate(held, axis=1)
            cols = cols[:, np.lexsort(cols[::-1])]
            for block, at in enumerate(range(0, n, block_rows)):
                part = cols[:, at : at + block_rows].tolist()
                yield _block_batch([(run, block, len(part[0]), list(zip(*part, strict=True)))], ["run", "block", "n", *_KEY])

        for batch in batches:
            for at in range(0, batch.num_rows, run_rows):
                part = batch.slice(at, run_rows)
                if n and n + part.num_rows > run_rows:
                    yield from flush()
                    run, held, n = run + 1, [], 0
                held.append(np.stack([np.asarray(c) for c in part.columns]))
                n += part.num_rows
        if n:
            yield from flush()

    unknown = F.col("doc_id").isNull().cast("bigint")
    keys = rows.filter("eligible").select((-F.col("score")).alias("score"), unknown.alias("unknown"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "n_features", "rid")
    return keys.mapInArrow(sort, _BLOCK)


def _borders(runs: DataFrame, draws: int, total: int, bin_rows: int, sample: int) -> list[tuple]:
    """Borders of bins of about ``bin_rows`` keys over the best of the order, and a margin, from at most about ``sample`` block heads."""
    blocks = runs.count()
    some = runs if blocks <= sample else runs.filter(F.pmod(F.xxhash64("run", "block"), F.lit(-(-blocks // sample))) == 0)
    heads = sorted(tuple(r) for r in some.select(*(F.element_at(c, 1) for c in _KEY)).collect())
    reach = min(len(heads), int(len(heads) * draws / total * 1.25) + 1)
    bins = max(1, min(reach, -(-draws * 5 // (4 * bin_rows))))
    return sorted({heads[k * reach // bins] for k in range(1, bins)} | ({heads[reach]} if reach < len(heads) else set()))


def draw_best(rows: DataFrame, percent: int = PERCENT, run_rows: int = 1 << 17, block_rows: int = 1 << 10, bin_rows: int = 1 << 16, sample: int = 20_000) -> DataFrame:
    """(rid, rank) of the best floor(percent * N / 100) of the N eligible ``rows``, which are stored; rank from 1."""
    runs = stored(sorted_runs(rows, run_rows, block_rows), "importance-runs")
    total = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    draws = percent * total // 100
    if not draws:
        return rows.select("rid", F.lit(0).cast("bigint").alias("rank")).limit(0)
    borders = _borders(runs, draws, total, bin_rows, sample)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, at = _keys(row), 0
                while at < len(keys):
                    bin_ = bisect_right(borders, keys[at])
                    end = bisect_left(keys, borders[bin_], at) if bin_ < len(borders) else len(keys)
                    yield _block_batch([(bin_, row["run"], end - at, keys[at:end])], ["bin", "run", "n", *_KEY])
                    at = end

    slices = runs.drop("block").select("run", "n", *_KEY).mapInArrow(cut, _BLOCK.replace("run bigint, block bigint", "bin bigint, run bigint"))
    # one row a bin: where its ranks begin
    firsts, begin = {}, 0
    for bin_, n in sorted(tuple(r) for r in slices.groupBy("bin").agg(F.sum("n")).collect()):
        if begin < draws:
            firsts[bin_] = begin
        begin += n
    last = max(firsts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple[int, list[tuple]]]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    yield row["bin"], _keys(row)

        source, ahead = rows_of(), []
        ahead = [next(source, None)]

        def of_bin(bin_: int) -> Iterator[list[tuple]]:
            while ahead[0] is not None and ahead[0][0] == bin_:
                keys, ahead[0] = ahead[0][1], next(source, None)
                yield keys

        while ahead[0] is not None:
            bin_ = ahead[0][0]
            rank, rids, blocks = firsts[bin_], [], of_bin(bin_)
            for key in merge_runs(blocks):
                if rank + len(rids) >= draws:
                    break
                rids.append(key[-1])
                if len(rids) == 1 << 14:
                    yield _ranked(rids, rank)
                    rank, rids = rank + len(rids), []
            if rids:
                yield _ranked(rids, rank)
            for _ in blocks:  # what lies beyond the draw
                pass

    needed = slices.filter(F.col("bin") <= last).repartition(max(1, min(len(firsts), 4096)), "bin")
    ordered = needed.sortWithinPartitions("bin", *(F.element_at(c, 1) for c in _KEY))
    return ordered.mapInArrow(merge, "rid bigint, rank bigint")


def _ranked(rids: list[int], before: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(np.arange(before + 1, before + len(rids) + 1))], ["rid", "rank"])


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, **sizes) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_features, weight, score, rank (null: not drawn), n_words. ``target`` (text) is what the draw should look like."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = stored(scored(docs, gain, least_words, seed), "importance-scores")
    return rows.join(draw_best(rows, percent, **sizes), "rid", "left").select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


#: Features of all texts as rows; their hashes byte by byte.
ORACLE = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
both_sides AS (SELECT 'd' AS side, row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
split AS (SELECT side, rid, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM both_sides),
words AS (SELECT side, rid, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM split),
runs AS (SELECT side, rid, w AS one, CASE WHEN lead(w, 1) OVER o IS NOT NULL THEN w || ' ' || lead(w, 1) OVER o END AS two, CASE WHEN lead(w, 2) OVER o IS NOT NULL THEN w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o END AS three
  FROM words WINDOW o AS (PARTITION BY side, rid ORDER BY k)),
features AS (SELECT side, rid, unnest([one, two, three]) AS f FROM runs),
counted AS (SELECT side, rid, f, count(*) AS n FROM features WHERE f IS NOT NULL GROUP BY ALL),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), tab),
placed AS (SELECT side, rid, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
per AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM placed GROUP BY bucket),
gained AS (SELECT bucket, floor(1000 * ln((t + 1)::double * ((SELECT sum(s) FROM per) + 10000)::double / ((s + 1)::double * ((SELECT sum(t) FROM per) + 10000)::double)))::bigint AS gain FROM per),
weighed AS (SELECT rid, sum(n)::bigint AS n_features, sum(n * gain)::bigint AS weight FROM placed JOIN gained USING (bucket) WHERE side = 'd' GROUP BY rid),
scored AS (SELECT doc_id, coalesce(n_features, 0)::bigint AS n_features, coalesce(weight, 0)::bigint AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint)::bigint AS score, len(w) >= 20 AS eligible
  FROM split LEFT JOIN weighed USING (rid) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k, count(*) OVER (PARTITION BY eligible) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND k <= n * 5 // 100 THEN k END AS rank FROM ranked
"""
