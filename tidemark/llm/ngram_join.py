"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

The join finds all pairs of documents whose sets of five-word shingles have a Jaccard similarity of at least
``threshold``. Words are runs without blanks; a text of fewer than five words has one shingle of all its words.

* Equal texts are one node; what follows sees distinct texts only.
* *Forest*: each of ``TREES`` trees labels a text by ``DEPTH`` of its MinHash values. Texts that share the first
  ``LEAST`` values meet in one task, sorted by label, which is the trie in order. Matching starts with the longest
  prefix and shortens it, value by value, until each text has a partner and the estimated recall (each match weighed by
  the chance that a pair so similar meets) reaches ``recall``, or the prefix is at its least, where a pair at the
  threshold meets with a chance of 0.998. Within a prefix, groups grow from each text to all that its signature is
  loosely like, until none is left out: which texts are joined doesn't depend on their order.
* A least prefix that more than ``FULL`` texts share isn't compared: all its texts are one group, made by partial sums.
* Loose matches are joined to groups, and *every* pair of a group is verified exactly. Pairs are counted, not emitted:
  a group's common shingles are taken out first, so that near copies compare only by what differs. Groups of more than
  ``BLOCK`` texts or ``BLOCK_BYTES`` of shingles are verified in pairs of blocks, each a task of bounded size.

One row per document: class_id (smallest doc_id of its component of links), n_links (other documents at or above the
threshold, copies included).

Defined cases: null text counts as empty; texts without words equal each other; repeated rows are documents of their
own and linked; a null ``doc_id`` takes part (class_id is null only if all ids of the class are); extra columns are
ignored; an empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import one_each, slices, small, stored, table, text_or_empty, without
from tidemark.llm.components import components

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH, LEAST = 16, 8, 5
RECALL = 0.999
#: Signatures that agree less than this belong to no pair at the threshold (over three standard errors below it).
LOOSE = 0.64
FULL = 4096
BLOCK = 20_000
BLOCK_BYTES = 8 << 20

_SLOTS = TREES * DEPTH
_A = (np.random.default_rng(11).integers(1, 2**31, _SLOTS).astype(np.uint32) * np.uint32(2)) + np.uint32(1)
_B = np.random.default_rng(12).integers(0, 2**32, _SLOTS).astype(np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_PART = 4 << 20
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles in order, where each text's begin; one more entry at the end)."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_BLANK[raw]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8))))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a word's hash from running sums, one part of the bytes at a time; parts end after a word
    hashes, at, k = np.empty(len(start), np.uint64), 0, 0
    while k < len(start):
        at = start[k]
        n = max(1, int(np.searchsorted(end, at + _PART, "right")) - k)
        part = raw[at : end[k + n - 1]]
        sums = np.concatenate(([np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(part)))))
        s, e = start[k : k + n] - at, end[k : k + n] - at
        hashes[k : k + n] = (sums[e] - sums[s]) * _powers(pow(_BASE, -1, 2**64), len(part))[s]
        k += n
    hashes = _mixed(hashes)
    bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
    counts = np.diff(bounds)
    made = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(made)))
    place = np.arange(first[-1]) - np.repeat(first[:-1], made) + np.repeat(bounds[:-1], made)
    width = np.repeat(np.minimum(counts, WORDS), made)
    padded = np.concatenate([hashes, np.zeros(WORDS, np.uint64)])
    out = np.zeros(len(place), np.uint64)
    for j in range(WORDS):
        out = out * np.uint64(0x100000001B3 * 2 + 1) + np.where(j < width, padded[place + j], np.uint64(0))
    return _mixed(out), first


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(MinHash values, texts × _SLOTS (uint32), number of shingles); a text without shingles has only the largest value."""
    out = np.full((len(texts), _SLOTS), np.uint32(0xFFFFFFFF))
    hashes, first = shingles(texts)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for at in range(0, len(some), 512):  # texts whose shingles stay in the cache
            part = some[at : at + 512]
            lo, hi = first[part[0]], first[part[-1] + 1]
            v, cut = x[lo:hi], first[part] - lo
            for k in range(_SLOTS):
                y = v * _A[k] + _B[k]
                out[part, k] = np.minimum.reduceat(y ^ (y >> np.uint32(15)), cut)
    return out, np.diff(first)


def _chance(s: np.ndarray, depth: int) -> np.ndarray:
    return 1 - (1 - s**depth) ** TREES


def _grown(sig: np.ndarray, group: np.ndarray) -> list[tuple[int, int, float]]:
    """Matches that join the groups given (a number for each row) to those of all loosely like texts, each joined once."""
    found, rest = [], np.arange(len(sig))
    while len(rest) > 1:
        inside = group[rest] == group[rest[0]]
        queue, rest = rest[inside].tolist(), rest[~inside]
        while queue and len(rest):
            x = queue.pop()
            s = (sig[rest] == sig[x]).mean(1)
            near = np.flatnonzero(s >= LOOSE)
            if len(near):
                found += [(x, int(y), v) for y, v in zip(rest[near], s[near], strict=True)]
                joined = np.isin(group[rest], group[rest[near]])
                queue += rest[joined].tolist()
                rest = rest[~joined]
    return found


def _matched(label: np.ndarray, sig: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (as row numbers) of texts that share the least prefix; rows are sorted by label."""
    edges: list[tuple[int, int]] = []
    sims: list[float] = []
    met, group = np.zeros(len(label), bool), np.arange(len(label))
    for depth in range(DEPTH, LEAST - 1, -1):
        new = np.flatnonzero((label[1:, :depth] != label[:-1, :depth]).any(1)) + 1
        bounds, had = [0, *new, len(label)], len(edges)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                for i, j, s in _grown(sig[a:b], group[a:b]):
                    edges.append((a + i, a + j))
                    sims.append(s)
                    met[[a + i, a + j]] = True
        if len(edges) > had:
            group = _roots(len(label), np.array(edges))
        if sims and met.all() and len(sims) >= RECALL * (1 / _chance(np.array(sims), depth)).sum():
            break
    return edges


def _roots(n: int, edges: np.ndarray) -> np.ndarray:
    """Smallest index of each of n nodes' component."""
    root = np.arange(n)
    while len(edges):
        a, b = root[edges[:, 0]], root[edges[:, 1]]
        low = np.minimum(a, b)
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (key, label, node, sig) to edges (a, b): stars around the smallest node of what matches."""

    def edges_of(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        label = np.frombuffer(b"".join(group["label"]), ">u4").reshape(-1, DEPTH)
        sig = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(-1, _SLOTS)
        node = group["node"].to_numpy()
        order = np.argsort(node, kind="stable")
        place = np.empty(len(node), np.int64)
        place[order] = np.arange(len(node))
        pairs = np.array(_matched(label, sig), np.int64).reshape(-1, 2)
        root = _roots(len(node), place[pairs])
        return node[order], node[order][root]

    held: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        key = rows["key"].to_numpy()
        new = np.flatnonzero(key[1:] != key[:-1]) + 1
        bounds = np.concatenate(([0], new))
        held = rows.iloc[bounds[-1] :]
        out = [edges_of(rows.iloc[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a > 1]
        if out:
            a, b = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
            yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})
    if held is not None and len(held) > 1:
        a, b = edges_of(held)
        yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})


def verified(sets: list[np.ndarray], threshold: float, own: np.ndarray, other: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links of each set, smallest index of its component) over the pairs (i in own, j in other), each pair once.

    Shared shingles of most sets are taken out: |A ∩ B| = |C| - |C-A| - |C-B| + |(C-A) ∩ (C-B)| + |(A-C) ∩ (B-C)|."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    values, ids, count = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    common = count * 2 > n
    c = int(common.sum())
    inside = common[ids]
    missing = c - np.bincount(owner[inside], minlength=n)
    # rows by value: of rare values those who have it, of common ones those who lack it
    has = np.flatnonzero(~inside & (count[ids] > 1))
    lists_value, lists_owner = [ids[has]], [owner[has]]
    for at in range(0, c, 256):  # a bounded piece of the complement at a time
        some = np.flatnonzero(common)[at : at + 256]
        there = np.zeros((len(some), n), bool)
        local = np.full(len(values), -1)
        local[some] = np.arange(len(some))
        pick = local[ids] >= 0
        there[local[ids[pick]], owner[pick]] = True
        v, o = np.nonzero(~there)
        lists_value.append(some[v])
        lists_owner.append(o)
    value, who = np.concatenate(lists_value), np.concatenate(lists_owner)
    by_who = np.argsort(who, kind="stable")
    value_of, start_of = value[by_who], np.searchsorted(who[by_who], np.arange(n + 1))
    by_value = np.argsort(value, kind="stable")
    who_of, start_v = who[by_value], np.searchsorted(value[by_value], np.arange(len(values) + 1))
    links, edges = np.zeros(n, np.int64), []
    in_other = np.zeros(n, bool)
    in_other[other] = True
    same = len(own) == n
    for i in own:
        mine = value_of[start_of[i] : start_of[i + 1]]
        shared = np.zeros(n, np.int64)
        if len(mine):
            reach = start_v[mine + 1] - start_v[mine]
            flat = np.repeat(start_v[mine] - np.concatenate(([0], np.cumsum(reach)[:-1])), reach) + np.arange(reach.sum())
            shared = np.bincount(who_of[flat], minlength=n)
        inter = c - missing[i] - missing + shared
        union = size[i] + size - inter
        linked = (inter >= threshold * union - 1e-9) & in_other
        linked[i] = False
        if same:
            linked[: i + 1] = False
        j = np.flatnonzero(linked)
        if len(j):
            links[i] += weight[j].sum()
            links[j] += weight[i]
            edges.append(np.column_stack([np.full(len(j), i), j]))
            if len(edges) > 64:
                edges = [_star(_roots(n, np.concatenate(edges)))]
    return links, _roots(n, np.concatenate(edges) if edges else np.zeros((0, 2), np.int64))


def _star(root: np.ndarray) -> np.ndarray:
    k = np.flatnonzero(root != np.arange(len(root)))
    return np.column_stack([k, root[k]])


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, keep_text_hash: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, class_size, representative (one row of each class)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    keyed = rows.withColumn("sha", F.unhex(F.sha2("text", 256)))
    rids = stored(keyed.select("doc_id", "sha", F.xxhash64("text").alias("_hash")).withColumn("rid", F.monotonically_increasing_id()), "join-rows")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s, count = signatures(part.column("text").to_pylist())
                labels = s.reshape(-1, TREES, DEPTH).astype(">u4").tobytes()
                low = _mixed(s.astype(np.uint64)).astype(np.uint8).tobytes()
                n = TREES * DEPTH * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column("sha"), pa.array([labels[k : k + n] for k in range(0, len(labels), n)], pa.binary()), pa.array([low[k : k + _SLOTS] for k in range(0, len(low), _SLOTS)], pa.binary()), pa.array(count, pa.int64())],
                    ["sha", "labels", "sig", "shingles"],
                )

    signed = keyed.select("sha", F.col("text").cast("binary").alias("text")).mapInArrow(sign, "sha binary, labels binary, sig binary, shingles bigint")
    nodes = signed.groupBy("sha").agg(F.first("labels").alias("labels"), F.first("sig").alias("sig"), F.first("shingles").alias("shingles"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "join-nodes")
    width = DEPTH * 4
    label = lambda t: F.col("labels").substr(t * width + 1, F.lit(width))
    prefix = lambda t: F.xxhash64(t, F.substring(label(t), 1, LEAST * 4))
    every_tree = lambda f: F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), f))
    keys = nodes.select("node", every_tree(prefix).alias("key"))
    full = stored(keys.groupBy("key").count().filter(F.col("count") > FULL).select("key"), "join-full")
    trees = nodes.select("node", "sig", every_tree(lambda t: F.struct(prefix(t).alias("key"), label(t).alias("label"))).alias("t")).select("node", "sig", "t.*")
    some_full = not full.isEmpty()
    if some_full:
        trees = trees.join(small(full), "key", "left_anti")
    trees = trees.repartition("key").sortWithinPartitions("key", "label", "node")
    edges = trees.select("key", "label", "node", "sig").mapInPandas(_forest, "a bigint, b bigint")
    if some_full:
        many = keys.join(small(full), "key")
        first = stored(many.groupBy("key").agg(F.min("node").alias("b")), "join-full-groups")
        edges = edges.unionByName(many.join(small(first), "key").select(F.col("node").alias("a"), "b"))
    groups = components(edges, "join-groups")

    # exact verification inside groups
    members = stored(groups.join(nodes.select("node", "sha", "shingles"), "node"), "join-members")
    per_sha = rids.groupBy("sha").agg(F.count("*").alias("copies"), F.min("rid").alias("rid"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("shingles") * 8 / BLOCK_BYTES)).cast("int")
    sizes = stored(members.groupBy("root").agg(blocks.alias("blocks")).filter("blocks > 1"), "join-large")
    members = members.join(small(sizes), "root", "left").join(per_sha, "sha").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = stored(members.select("sha", "node", "root", "copies", "blocks", "block"), "join-blocks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text")):
            h, first = shingles(batch.column("text").to_pylist())
            sets = [np.unique(h[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("node", "root", "copies", "blocks", "block")} | {"shingles": pa.array(sets, pa.binary())})

    texts = keyed.join(small(members), "sha").select("node", "root", "copies", "blocks", "block", F.col("text").cast("binary").alias("text"))
    cuts = texts.mapInArrow(cut, "node bigint, root bigint, copies bigint, blocks int, block int, shingles binary")
    # a block meets itself and every other block of its group
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("p"), F.greatest(x, F.col("block")).alias("q")))
    cuts = cuts.withColumn("pair", F.explode(pair)).dropDuplicates(["node", "pair"])

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable", ignore_index=True)
        sets = [np.frombuffer(b, np.uint64) for b in group["shingles"]]
        pair, block, every = group["pair"].iloc[0], group["block"].to_numpy(), np.arange(len(group))
        own, other = (every, every) if pair["p"] == pair["q"] else (every[block == pair["p"]], every[block == pair["q"]])
        links, root = verified(sets, threshold, own, other, group["copies"].to_numpy())
        node = group["node"].to_numpy()
        return pd.DataFrame({"node": node, "links": links, "least": node[root]})

    found = stored(cuts.groupBy("root", "pair").applyInPandas(verify, "node bigint, links bigint, least bigint"), "join-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")), "join-classes").select("node", F.col("root").alias("class"))
    every = members.select("node", "sha").join(links, "node").join(linked, "node", "left").withColumn("class", F.coalesce("class", "node"))
    repeated = per_sha.filter("copies > 1").join(every, "sha", "full")
    repeated = repeated.select("sha", F.coalesce("links", F.lit(0)).alias("links"), F.col("class"))
    known = per_sha.filter("copies > 1").select("sha", "copies").join(repeated, "sha", "right")
    known = stored(known.select("sha", F.coalesce("copies", F.lit(1)).alias("copies"), "links", F.coalesce(F.col("class").cast("string"), F.hex("sha")).alias("class")), "join-known")
    out = stored(rids.join(small(known), "sha", "left").select("doc_id", "rid", "_hash", "class", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")), "join-out")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("first")
    classes = out.filter("class is not null").groupBy("class").agg(first, F.count("*").alias("class_size"))
    classes = stored(classes.select("class", F.col("first.doc_id").alias("class_id"), F.col("first.rid").alias("of"), "class_size"), "join-class-ids")
    out = out.join(small(classes), "class", "left")
    return out.select(
        "doc_id",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "n_links",
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce(F.col("rid") == F.col("of"), F.lit(True)).alias("representative"),
        *(["_hash"] if keep_text_hash else []),
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def drop_similar(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document, the smallest, of each class, all columns."""
    spread = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = similar_documents(spread, threshold, keep_text_hash=True)
    found = stored(found.filter("class_size > 1").select(F.col("doc_id").alias("_id"), "_hash", "representative"), "similar-decisions")
    gone = found.groupBy("_id", "_hash").agg(F.max("representative").alias("kept"), F.count("*").alias("rows"))
    gone, ties = gone.filter("not kept").select("_id", "_hash"), gone.filter("kept and rows > 1").select("_id", "_hash")
    key = F.xxhash64(text_or_empty())
    kept = without(docs, gone, key)
    if ties.isEmpty():
        return kept
    # rows repeated with the same id and text: one of them
    return without(kept, ties, key).unionByName(one_each(without(docs, ties, key, "left_semi"), key))
