"""Repeated substrings across documents, by sorting one suffix bucket at a time with a difference cover.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else (in any document, the same included)
is removed. Strings are judged on the input; matches never cross documents.

* *Equal texts* are one text with a count; a text of at least ``LENGTH`` bytes that has copies goes as a whole.
* *Buckets*: of the grams of ``GRAM`` bytes within a string of ``LENGTH`` bytes, the one with the smallest hash stands
  for all suffixes that start there. The choice depends on the bytes alone, so that two suffixes that agree for
  ``LENGTH`` bytes are in one bucket. Neighbouring suffixes of a bucket are a run; about one place in 150 begins one.
* Buckets whose gram stands at one place only hold no repeat and are dropped before any text is moved.
* *Blocks*: the suffixes of the other buckets meet in a task, one bucket (or a few small ones) at a time. First the places
  that ``COVER`` marks in every ``PERIOD`` bytes, a difference cover, are ranked by doubling. Suffixes are then sorted by
  their first and last bytes; ties, however long, are resolved by the ranks of the cover sample at a place that both
  share, which a difference cover has within ``PERIOD`` bytes for any two. All ranks are exact, not hashes.
* A bucket of more than ``HOT_BYTES`` is too large for a task. Its runs are cut into pieces of ``PIECE`` starts, aligned
  with the gram, and counted as digests with partial sums: of equal pieces every suffix is repeated. Pieces whose core
  (what all their suffixes share) is found in another piece are spelt out as 128-bit fingerprints of suffixes.

Memory per task is bounded by ``HOT_BYTES`` or one part of a text. Defined cases: null text counts as empty; repeated
rows are copies of each other; a null ``doc_id`` is kept as it is; extra columns are ignored; an empty table gives an
empty result; texts of any length are read whole, in overlapping parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, small, stored, table, text_or_empty

LENGTH = 400
GRAM = 96
#: Suffixes of one run at most; bytes of a bucket that one task sorts at most, or about so many of small ones together.
RUN = 4096
HOT_BYTES = 2 << 20
#: Starts of a piece of a larger bucket.
PIECE = 16
#: A difference cover: the differences of its members are all residues of the period.
PERIOD = 16
COVER = (0, 1, 2, 5, 8)
_PART = 2 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


def ranks(raw: np.ndarray, length: int, bases: tuple[int, ...] = _BASES) -> np.ndarray:
    """Fingerprints of all strings of ``length`` bytes in ``raw``, by their start."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for base in bases:
        up = _powers(base, len(raw))
        sums = np.concatenate(([np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up)))
        total = _mixed(total + (sums[length:] - sums[:-length]) * _powers(pow(base, -1, 2**64), n))
    return total


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.concatenate([x, np.full(-len(x) % width, ~np.uint64(0))]).reshape(-1, width)
    before = np.minimum.accumulate(padded, 1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start, suffixes, gram hash, whether the gram stands there twice) of the runs of neighbouring suffixes with one sample gram."""
    out: list[tuple] = []

    def flush(pieces: list[tuple[int, int, bytes]]) -> None:
        raw = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        size = np.array([len(p[2]) for p in pieces])
        base = np.cumsum(size) - size
        # places of the smallest gram in each string, the first and the last; ties go by place
        g, mask = ranks(raw, gram, _BASES[:1]), np.uint64((1 << 24) - 1)
        place = np.arange(len(g), dtype=np.uint64)
        left = sliding_min((g & ~mask) | place, length - gram + 1) & mask
        right = mask - (sliding_min((g & ~mask) | (mask - place), length - gram + 1) & mask)
        n = np.maximum(size - length + 1, 0)
        owner = np.repeat(np.arange(len(pieces)), n)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        left, right = left[base[owner] + inner], right[base[owner] + inner]
        h = g[left.astype(np.int64)]
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))) if len(h) else np.zeros(0, int)
        count = np.diff(np.append(new, len(h)))
        parts = -(-count // RUN)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(new, parts) + step * RUN
        n_at = np.minimum(RUN, np.repeat(count, parts) - step * RUN)
        several = np.logical_or.reduceat(left != right, at) | (left[at] != left[at + n_at - 1]) if len(at) else np.zeros(0, bool)
        where = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
        out.append((where[0][owner[at]], where[1][owner[at]] + inner[at], n_at, h[at], several))

    held, waiting = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), _PART):
            held.append((k, at, text[at : at + _PART + length - 1]))
            waiting += len(held[-1][2])
            if waiting >= _PART:
                flush(held)
                held, waiting = [], 0
    if held:
        flush(held)
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spans_of(start: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Union of [s, s + length) of sorted starts."""
    if not len(start):
        return []
    cut = np.flatnonzero(np.diff(start) > length) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(start) - 1]))
    return [(int(a), int(b) + length) for a, b in zip(start[first], start[last], strict=True)]


def _dense(x: np.ndarray) -> np.ndarray:
    """Ranks of values without gaps."""
    return np.unique(x, return_inverse=True)[1].astype(np.uint64)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _dense((a << np.uint64(32)) | b)


def repeated_suffixes(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes that start ``at`` agree with another one for ``length`` (32 at least) bytes, exactly."""
    if len(at) < 2:
        return np.zeros(len(at), bool)
    k = (length - PERIOD) // PERIOD  # periods that a rank of the sample covers
    padded = np.concatenate([raw, np.zeros(-len(raw) % PERIOD + length + 2 * PERIOD, np.uint8)])
    n = len(padded) - PERIOD
    words = np.zeros(n + 8, np.uint64)
    for j in range(8):
        words |= padded[j : j + n + 8].astype(np.uint64) << np.uint64(8 * (7 - j))
    words = _dense(words)
    short = _paired(words[:n], words[8:])  # ranks of PERIOD bytes everywhere
    del words
    # ends first: what is unique there needs no more
    ends = short[at]
    for tail in range(PERIOD, length - k * PERIOD + PERIOD, PERIOD):
        ends = _paired(ends, short[at + length - tail])
    tied = np.flatnonzero(np.bincount(ends.astype(np.int64))[ends.astype(np.int64)] > 1)
    hit = np.zeros(len(at), bool)
    if not len(tied):
        return hit
    sample = np.stack([short[d : n - n % PERIOD : PERIOD] for d in COVER])
    span = 1
    while 2 * span <= k:
        sample[:, :-span] = _dense((sample[:, :-span] << np.uint64(32)) | sample[:, span:]).reshape(len(COVER), -1)
        span *= 2
    if span < k:
        rest = k - span
        sample[:, :-rest] = _dense((sample[:, :-rest] << np.uint64(32)) | sample[:, rest:]).reshape(len(COVER), -1)
    row = np.full(PERIOD, -1)
    row[list(COVER)] = np.arange(len(COVER))
    for shift in range(PERIOD):
        place = at[tied] + shift
        which = row[place % PERIOD]
        some = np.flatnonzero(which >= 0)
        key = (ends[tied[some]] << np.uint64(32)) | sample[which[some], place[some] // PERIOD]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        hit[tied[some[order[1:][same]]]] = True
        hit[tied[some[order[:-1][same]]]] = True
    return hit


def _sorted_bucket(context: list[bytes], lo: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Spans of each run whose suffixes are repeated among the runs given."""
    size = np.array([len(c) for c in context])
    n = size - length + 1
    owner = np.repeat(np.arange(len(context)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    hit = repeated_suffixes(np.frombuffer(b"".join(context), np.uint8), (np.cumsum(size) - size)[owner] + inner, length)
    at = np.flatnonzero(hit)
    bounds = np.searchsorted(owner[at], np.arange(len(context) + 1))
    start = lo[owner[at]] + inner[at]
    return [spans_of(start[a:b], length) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def pieces_of(context: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(place of the gram by starts of PIECE, first start, starts, digest of the core, digest of the piece) of a run."""
    g, mask = ranks(np.frombuffer(context, np.uint8), gram, _BASES[:1]), np.uint64((1 << 24) - 1)
    left = (sliding_min((g & ~mask) | np.arange(len(g), dtype=np.uint64), length - gram + 1) & mask).astype(np.int64)
    cell = (left - np.arange(len(left))) // PIECE
    new = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (cell[1:] != cell[:-1]))))
    digest = lambda b: hashlib.blake2b(b, digest_size=16).digest()
    for a, b in zip(new.tolist(), np.append(new[1:], len(left)).tolist(), strict=True):
        last = int(left[a] - cell[a] * PIECE)  # the last start that a whole piece of this place would have
        yield int(cell[a]), a, b - a, digest(context[last : last - PIECE + 1 + length]), digest(context[a : b - 1 + length])


def _hot_spans(context: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, start, end) for runs (h, id, lo, context) of large buckets."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("cell", pa.int32()), ("core", pa.binary()), ("piece", pa.binary()), ("id", pa.binary()), ("lo", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
        for batch in (part for b in batches for part in slices(b, "context")):
            rows = [(h, c, core, piece, key, lo, at, n) for h, key, lo, text in zip(*(batch.column(x).to_pylist() for x in ("h", "id", "lo", "context")), strict=True) for c, at, n, core, piece in pieces_of(text, length, gram)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    each = stored(context.mapInArrow(cut, "h bigint, cell int, core binary, piece binary, id binary, lo bigint, at int, n int"), "suffix-pieces")
    kinds = each.groupBy("h", "cell", "core", "piece").agg(F.count("*").alias("copies"), F.min(F.struct("id", "lo", "at", "n")).alias("one"))
    kinds = stored(kinds, "suffix-kinds")
    copied = stored(kinds.filter("copies > 1").select("h", "cell", "core", "piece"), "suffix-copied-pieces")
    whole = each.join(small(copied), ["h", "cell", "core", "piece"]).select("id", (F.col("lo") + F.col("at")).alias("start"), (F.col("lo") + F.col("at") + F.col("n") - 1 + length).alias("end"))
    # one piece of each kind whose core stands in another kind, too
    shared = kinds.groupBy("h", "cell", "core").count().filter("count > 1").drop("count")
    open_ = kinds.join(shared, ["h", "cell", "core"]).select("one.*", (F.col("copies") == 1).alias("single"))
    lists = open_.groupBy("id", "lo").agg(F.collect_list(F.struct("at", "n", "single")).alias("list"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "context", 200)):
            out: list[tuple] = []
            for key, lo, text, some in zip(*(batch.column(x).to_pylist() for x in ("id", "lo", "context", "list")), strict=True):
                for p in some:
                    piece = np.frombuffer(text[p["at"] : p["at"] + p["n"] - 1 + length], np.uint8)
                    f = np.column_stack([ranks(piece, length), ranks(piece, length, _BASES[::-1])]).tobytes()
                    out += [(f[16 * k : 16 * k + 16], key, lo + p["at"] + k, p["single"]) for k in range(p["n"])]
            if out:
                f, key, start, single = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), pa.array(key, pa.binary()), pa.array(start, pa.int64()), pa.array(single)], ["f", "id", "start", "single"])

    spelt = stored(context.join(lists, ["id", "lo"]).select("id", "lo", "context", "list").mapInArrow(spell, "f binary, id binary, start bigint, single boolean"), "suffix-spelt")
    twice = spelt.groupBy("f").count().filter("count > 1").select("f")
    return whole.unionByName(spelt.filter("single").join(twice, "f").select("id", "start", (F.col("start") + length).alias("end")))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(id, start, end) of removed pieces, possibly overlapping, of distinct texts (id: binary, text: binary)."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text", 2000, 4 << 20)):
            text, lo, n, h, several = runs(batch.column("text").to_pylist(), length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("id").take(pa.array(text)), pa.array(lo, pa.int64()), pa.array(n, pa.int32()), pa.array(several)], ["h", "id", "lo", "n", "several"])

    found = stored(texts.mapInArrow(sample, "h bigint, id binary, lo bigint, n int, several boolean"), "suffix-runs")
    size = F.sum(F.col("n").cast("bigint") + length - 1)
    buckets = found.groupBy("h").agg(F.count("*").alias("runs"), F.max("several").alias("twice"), size.alias("size"))
    buckets = stored(buckets.filter("runs > 1 or twice").select("h", (F.col("size") > hot_bytes).alias("hot")), "suffix-buckets")
    found = found.join(small(buckets), "h")
    per_text = found.groupBy("id").agg(F.collect_list(F.struct("lo", "n", "h", "hot")).alias("list"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("id", pa.binary()), ("lo", pa.int64()), ("hot", pa.bool_()), ("context", pa.binary())])
        for batch in (part for b in batches for part in slices(b, "text")):
            rows, size = [], 0
            for key, text, some in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "list")), strict=True):
                for r in some:
                    rows.append((r["h"], key, r["lo"], r["hot"], text[r["lo"] : r["lo"] + r["n"] + length - 1]))
                    size += len(rows[-1][4])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # texts are moved at every size: what they meet grows with them
    joined = texts.join(per_text.hint("shuffle_hash"), "id")
    context = joined.mapInArrow(contexts, "h bigint, id binary, lo bigint, hot boolean, context binary")
    n_hot = buckets.filter("hot").limit(1).count()
    if n_hot:
        context = stored(context, "suffix-contexts")

    def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spread(rows: list[tuple]) -> pa.RecordBatch:
            got = _sorted_bucket([r[3] for r in rows], np.array([r[2] for r in rows]), length)
            flat = [(r[1], a, b) for r, x in zip(rows, got, strict=True) for a, b in x]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.binary()), pa.array([f[1] for f in flat], pa.int64()), pa.array([f[2] for f in flat], pa.int64())], ["id", "start", "end"])

        held, size = [], 0
        for batch in (part for b in batches for part in slices(b, "context")):
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "id", "lo", "context")), strict=True):
                if size > hot_bytes // 4 and row[0] != held[-1][0]:
                    yield spread(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield spread(held)

    cold = context.filter("not hot").select("h", "id", "lo", "context")
    out = cold.repartition("h").sortWithinPartitions("h").mapInArrow(sort_buckets, "id binary, start bigint, end bigint")
    return out.unionByName(_hot_spans(context.filter("hot").select("h", "id", "lo", "context"), length, gram)) if n_hot else out


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated (whether anything was removed), spans (array of start, end in bytes)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn("id", F.unhex(F.sha2("text", 256)))
    known = stored(rows.select("doc_id", "id", F.octet_length("text").cast("bigint").alias("n_bytes")), "suffix-rows")
    repeated = stored(known.groupBy("id").count().filter("count > 1").select("id"), "suffix-repeated")
    texts = rows.select("id", F.col("text").cast("binary").alias("text"))
    once = texts.join(small(repeated), "id", "left_anti")
    again = texts.join(small(repeated), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    texts = once.unionByName(stored(again, "suffix-copied"))
    pieces = stored(repeated_spans(texts, length, gram, hot_bytes), "suffix-spans")
    per_text = pieces.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("list"))
    per_text = per_text.join(small(repeated), "id", "left_anti")  # copied texts go as a whole

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        for batch in batches:
            rows = []
            for key, text, some in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "list")), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted((s["start"], s["end"]) for s in some):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                rows.append((key, sum(b - a for a, b in merged), len(merged), digest.hexdigest(), [{"start": a, "end": b} for a, b in merged]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    joined = once.join(per_text.hint("shuffle_hash"), "id")
    done = joined.mapInArrow(cut, "id binary, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")
    done = stored(done, "suffix-done")
    copied = repeated.withColumn("copied", F.lit(True))
    out = known.join(small(copied), "id", "left").join(small(done), "id", "left")
    whole = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("id")))).alias("kept_sha256"),
        (whole | (F.coalesce("n_removed", F.lit(0)) > 0)).alias("repeated"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("spans"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("spans")
