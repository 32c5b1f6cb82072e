"""The stages of the pipeline, each on what its predecessor kept, against brute force; empty tables and clashing columns."""

import collections
import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import suffix_dedup, toxicity
from tidemark.llm.common import table

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _hash string, _id int, _key string, _text_hash int, _i int, _k int, score double, rid int, label int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(23)
    word = lambda: "".join(r.choice(["an", "re", "ti", "on", "el", "st", "ü"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(prose(r.randint(20, 60)))) for k in range(5)] + [(9, None)]
    texts = [prose(r.randint(10, 120)) for _ in range(300)]
    marked = [k % 3 == 0 for k in range(300)]
    for words, bad in zip(texts, marked, strict=True):
        for _ in range(3 if bad else 0):
            words[r.randrange(len(words))] = r.choice(["blorg", "zarnik", "kwezt"])
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    labels = [(k, 1, int(b)) for k, b in enumerate(marked)]
    clean = [k for k in range(300) if not marked[k]]
    rows += [(400 + k, rows[clean[k]][1].replace(" ", " \n")) for k in range(20)]  # copies
    rows += [(500 + k, rows[clean[30]][1]) for k in range(30)] + [rows[clean[31]]] * 3
    for k in range(20):  # near copies
        w = list(texts[clean[40 + k]]) + prose(60)
        rows.append((600 + k, " ".join(w)))
        w[5] = "changed"
        rows.append((650 + k, " ".join(w)))
    rows += [(700 + k, " ".join([*prose(30), items[k % 5][1], *prose(9)])) for k in range(10)]
    rows += [(800, None), (801, ""), (802, " \t"), (None, " ".join(prose(40))), (803, " ".join(prose(5000)))]
    at = tmp_path_factory.mktemp("sf")
    extra = lambda k: ("en", f"s{k % 4}" if k % 9 else None, 1, "x", 2, "x", 3, 4, 5, 0.5, 6, 7)
    spark.createDataFrame([(*row, *extra(k)) for k, row in enumerate(rows)], COLUMNS).repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (803, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, dict(items)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words_of(text)
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])


def test_stages(spark, folder):
    at, rows, items = folder
    docs = table(spark, at, "documents")
    left, given = [], docs
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, at)
        if name != "mixing":
            assert docs.columns == given.columns, name
        docs.write.parquet(f"{at}/out-{name}")
        docs = spark.read.schema(docs.schema).parquet(f"{at}/out-{name}")
        left.append(([(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()], docs.collect()))
    of = lambda k: collections.Counter((r["doc_id"], r["text"]) for r in left[k][1])

    model = toxicity.BiGru().fitted(table(spark, at, "documents"), table(spark, at, "labels"))
    scores = model.scores([(t or "").lower().encode() for _, t in left[0][0]])
    assert of(0) == collections.Counter(row for row, s in zip(left[0][0], scores, strict=True) if s < 0.5)
    rude = [row for row in left[0][0] if re.search("blorg|zarnik|kwezt", row[1] or "")]
    assert len(rude) == 100 and sum(of(0)[row] > 0 for row in rude) <= 5 and sum(of(0).values()) >= len(rows) - 105

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in left[1][0]:
        groups[norm(t)].append(i)
    assert collections.Counter(r["doc_id"] for r in left[1][1]) == collections.Counter(min((i for i in g if i is not None), default=None) for g in groups.values())

    texts = left[2][0]
    sets, root = [frozenset(shingles(t)) for _, t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        n = len(sets[a] & sets[b])
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    ids = collections.defaultdict(list)
    for k, r in enumerate(root):
        ids[r].append(texts[k][0])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left[2][1]) == sorted((None in g and len(g) == 1, min((i for i in g if i is not None), default=0)) for g in ids.values())

    def leaks(text):
        s = [tuple(x.lower() for x in g) for g in shingles(text)] if len(words_of(text)) >= 5 else []
        for t in (collections.Counter(shingles(y)) for y in items.values() if y):
            m = sum(t.values())
            for k in range(max(1, len(s) - m + 1) if s else 0):
                n = sum((collections.Counter(s[k : k + m]) & t).values())
                if n >= 0.8 * (min(m, len(s)) + m - n):
                    return True
        return False

    assert of(3) == collections.Counter(row for row in left[3][0] if not leaks(row[1]))
    assert len(left[3][0]) - len(left[3][1]) == 10

    sizes = {i: len(words_of(t)) for i, t in left[4][0]}
    taken, slots = collections.Counter(), left[4][1]
    for r in slots:
        assert len(r["text"].split(" ")) == r["n_words"] <= 64
        for i in r["doc_ids"]:
            taken[i] += 1
    assert set(taken) <= set(sizes) and abs(sum(r["n_words"] for r in slots) - sum(sizes.values())) <= 0.1 * sum(sizes.values()) + 640


def test_empty(spark, folder, tmp_path):
    at, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.createDataFrame([], table(spark, at, name).schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert suffix_dedup.dedup_substrings(table(spark, str(tmp_path), "documents")).count() == 0


def test_long_texts_have_the_windows_of_the_whole():
    r = random.Random(2)
    text = "".join(r.choice(["ab", "c ", "dé ", ". ", "x" * 60 + " "]) for _ in range(9000)).encode()
    model = toxicity.BiGru()
    whole = model.raw_scores([text])
    parts = list(toxicity.text_parts(text, 5000))
    assert len(parts) > 5
    n = 0
    for part in parts:
        _, start, _ = toxicity.word_places(part)
        n += len(model.windows(np.array([len(start)]))[0])
    best = max(model.raw_scores([part])[0][0] for part in parts)
    assert best == pytest.approx(whole[0][0], abs=1e-4) and abs(n - round(float(2.718281828459045 ** whole[1][0]))) <= 1
