"""Repeated substrings, near copies, decontamination, classifiers and the pipeline, against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tidemark.llm import components, decontaminate, ngram_join, quality, suffix_dedup, toxicity


def removed(texts, length):
    data = [(t or "").encode() for _, t in texts]
    count = collections.Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    for b in data:
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, cover, strict=True) if not y)
        yield len(b), sum(cover), len(bytes(cover).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("length", "gram", "hot"), [(400, 96, 2 << 20), (60, 16, 2 << 20), (60, 16, 60), (60, 16, 4000), (400, 96, 1000)])
def test_substrings(docs, texts, length, gram, hot):
    got = suffix_dedup.dedup_substrings(docs, length, gram, hot).collect()
    want = collections.Counter((i, *x) for (i, _), x in zip(texts, removed(texts, length), strict=True))
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def sets_of(texts):
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        yield frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_copies(docs, texts):
    sets = list(sets_of(texts))
    links, root = collections.Counter(), list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        same = (texts[a][1] or "") == (texts[b][1] or "") or not sets[a] and not sets[b]
        n = len(sets[a] & sets[b])
        if same or (sets[a] and sets[b] and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)):
            links[a] += 1
            links[b] += 1
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    got = ngram_join.similar_documents(docs).collect()
    assert sum(r["representative"] for r in got) == len(set(root))
    ids = collections.defaultdict(list)
    for k, r in enumerate(root):
        ids[r].append(texts[k][0])
    low = lambda r: min((i for i in ids[r] if i is not None), default=None)
    want = collections.Counter((texts[k][0], low(root[k]), links[k]) for k in range(len(texts)))
    assert collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    left = ngram_join.drop_similar(docs)
    assert left.columns == docs.columns and left.count() == len(set(root))


def test_verified_in_blocks():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, r.integers(0, 100, k % 9)), r.integers(0, 2**63, k % 5).astype(np.uint64)])) for k in range(40)]
    weight, every = r.integers(1, 4, 40), np.arange(40)
    want = np.zeros(40, int)
    for a, b in itertools.combinations(range(40), 2):
        n = len(np.intersect1d(sets[a], sets[b]))
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            want[a] += weight[b]
            want[b] += weight[a]
    whole, _ = ngram_join.verified(sets, 0.8, every, every, weight)
    parts = np.zeros(40, int)
    for own, other in ((every[:15], every[15:]),):
        parts += ngram_join.verified(sets, 0.8, own, other, weight)[0]
    for half in (every[:15], every[15:]):
        parts[half] += ngram_join.verified([sets[k] for k in half], 0.8, np.arange(len(half)), np.arange(len(half)), weight[half])[0]
    assert (whole == want).all() and (parts == want).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200, 202: 200}


@pytest.fixture(scope="module")
def bench(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "nu", "pe"]) for _ in range(r.randint(1, 3)))
    items = [(k, " ".join(word() for _ in range(r.randint(14, 50)))) for k in range(12)] + [(50, None), (51, "too short"), (52, "")]
    words = lambda n: " ".join(word() for _ in range(n))
    docs = [(k, words(30) + "\n" + items[k][1] + " " + words(20)) for k in range(5)]
    for k in range(5, 9):  # near copies
        w = items[k][1].split()
        w[len(w) // 2] = "altered"
        docs.append((k, words(40) + " " + " ".join(w)))
    docs += [(20, items[9][1][: len(items[9][1]) // 3]), (21, items[10][1]), (22, items[11][1].upper()), (23, None), (24, ""), (25, words(300)), (None, items[3][1] + " " + words(5)), (2, docs[2][1]), (26, (items[1][1] + " ") * 50)]
    return docs, items, spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, m int, key string"), spark.createDataFrame([(i, t, "c") for i, t in items], "item_id bigint, text string, s string")


def test_leaks(bench):
    docs, items, docs_df, items_df = bench
    sh = lambda x: (lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)])(re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower()))
    want = {}
    for i, x in docs:
        s = sh(x)
        for j, y in items:
            t = collections.Counter(sh(y))
            m = sum(t.values())
            best = 0
            for a in range(max(1, len(s) - m + 1) if m and s else 0):
                w = collections.Counter(s[a : a + m])
                n = sum((w & t).values())
                best = max(best, n / (sum(w.values()) + m - n))
            if best >= 0.8:
                want[i, j] = max(best, want.get((i, j), 0))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs_df, items_df).collect()}
    assert got == pytest.approx(want)
    left = decontaminate.drop_leaks(docs_df, items_df)
    assert left.columns == docs_df.columns and sorted(r["doc_id"] for r in left.collect()) == sorted({i for i, _ in docs} - {i for i, _ in want})
    assert decontaminate.leaks(docs_df.limit(0), items_df).count() == 0 and decontaminate.leaks(docs_df, items_df.limit(0)).count() == 0


def test_leaks_of_edited_templates(spark):
    """Items that share an opening and a closing: the rarest shingles stand between an insertion and a deletion."""
    opening, closing = [f"open{k}" for k in range(50)], [f"close{k}" for k in range(74)]
    items = [(j, " ".join([*opening, *(f"mid{j}x{k}" for k in range(30)), *closing])) for j in range(4)]
    w = items[0][1].split()
    docs = [(0, " ".join([*w[:10], *"one two three four five".split(), *w[10:81], *w[86:], *(f"after{k}" for k in range(30))])), (1, " ".join(w[60:] + w[:60])), (2, " ".join(f"word{k}" for k in range(400)))]
    sh = lambda x: [tuple(x.split()[k : k + 5]) for k in range(len(x.split()) - 4)]
    want = {}
    for i, x in docs:
        for j, y in items:
            s, t = sh(x), collections.Counter(sh(y))
            m = sum(t.values())
            n = max(sum((collections.Counter(s[a : a + m]) & t).values()) for a in range(max(1, len(s) - m + 1)))
            if n / (2 * m - n) >= 0.8 and len(s) >= m:
                want[i, j] = n / (2 * m - n)
    assert (0, 0) in want and (1, 0) in want
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), radius=40)
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got.collect()} == pytest.approx(want)


def labelled(spark, bad):
    r = random.Random(11)
    word = lambda: "".join(r.choice(["an", "re", "ti", "on", "el", "st"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for k in range(600):
        words, marked = [word() for _ in range(r.randint(15, 60))], k % 3 == 0
        rows.append((k, bad(words, r) if marked else " ".join(words)))
        labels.append((k, 0 if marked else 1, 1 if marked else 0))
    rows += [(9001, None), (9002, ""), (None, "words without id"), (5, rows[5][1]), (9003, "long " * 40_000)]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, score string"), spark.createDataFrame([*labels, (9001, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def accuracy(scored, labels, column, threshold):
    rows = scored.join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0").collect()
    return np.mean([(r["score"] >= threshold) == (r[column] == 1) for r in rows if r[column] is not None])


def test_quality(spark):
    docs, labels = labelled(spark, lambda words, r: "!! ".join(words).upper() + "!!")
    out = quality.CompressionClassifier().fitted(docs, labels).score(docs)
    rows = out.collect()
    assert len(rows) == 605 and all(0 <= r["score"] <= 1 for r in rows)
    assert accuracy(out, labels, "quality", 0.3) > 0.95
    assert {r["score"] for r in quality.CompressionClassifier().fitted(docs, labels.limit(0)).score(docs).collect()} == {0.5}
    assert quality.CompressionClassifier().fitted(docs.limit(0), labels).score(docs.limit(0)).count() == 0


def test_toxicity(spark):
    def rude(words, r):
        for _ in range(3):
            words[r.randrange(len(words))] = r.choice(["blorg", "zarnik", "kwezt"]) + r.choice(["", "s", "er"])
        return " ".join(words)

    docs, labels = labelled(spark, rude)
    out = toxicity.BiGru(epochs=6).fitted(docs, labels).score(docs)
    rows = out.collect()
    assert len(rows) == 605 and all(0 <= r["score"] <= 1 for r in rows)
    assert accuracy(out, labels, "toxic", 0.5) > 0.9
    assert {r["score"] for r in toxicity.BiGru().fitted(docs, labels.limit(0)).score(docs).collect()} == {0.0}
    left = toxicity.drop_toxic(docs, labels.limit(0))
    assert left.columns == docs.columns and left.count() == docs.count()
    assert {r["score"] for r in toxicity.BiGru().fitted(docs, labels.filter("toxic = 1")).score(docs).collect()} == {1.0}


def test_toxicity_reads_text_without_blanks():
    data = ("短い。" + "長い文章は空白を持たない。" * 40 + " plain words " + "x" * 300 + " " + "y" * 64).encode()
    raw, start, end, _ = toxicity.words_of(data)
    assert max(end - start) <= 64 and (np.diff(start) > 0).all() and [data[a:b].decode() for a, b in zip(start, end)][-1] == "y" * 64
    covered = {k for a, b in zip(start, end) for k in range(a, b)}
    assert covered == {k for k, c in enumerate(data) if c != 32}
    r = random.Random(3)
    prose = lambda n: "".join(chr(0x4E00 + r.randrange(60)) for _ in range(n))
    bad = np.array([k % 2 for k in range(800)])
    texts = [prose(r.randint(30, 60)) + ("鬱魔厄鬼" if b else "") + prose(20) for b in bad]
    model = toxicity.BiGru().fit(texts[:600], bad[:600])
    assert ((model.scores([t.encode() for t in texts[600:]]) >= 0.5) == bad[600:]).mean() > 0.8


def test_gradients():
    m = toxicity.BiGru(word_slots=8, gram_slots=8)
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    r = np.random.default_rng(0)
    x, ids, size, want, weight = r.standard_normal((9, 16)), r.integers(0, 9, (5, 6)), np.array([6, 5, 3, 6, 1]), np.array([1, 0, 1, 0, 1]), np.ones(5)
    g, dx = m.gradients(x, ids, size, want, weight)

    def loss():
        v = m.logits(x, ids, size)
        return float((np.log1p(np.exp(v)) - want * v).sum())

    for a, d in ((x, dx), *((m.p[k], g[k]) for k in ("Wf", "Ub", "bf", "att", "out", "bias"))):
        at = (0,) * a.ndim
        a[at] += 1e-4
        up = loss()
        a[at] -= 2e-4
        down = loss()
        a[at] += 1e-4
        assert d[at] == pytest.approx((up - down) / 2e-4, abs=2e-3)


def test_recall_of_drifting_copies(spark, monkeypatch):
    """Chains of copies, each at 0.80 to 0.85 of the one before: nearly all of the links are found, also where prefixes are full."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows, links = [], []
    for family in range(60):
        words = [word() for _ in range(r.randint(120, 400))]
        for step in range(8):
            if step:
                before = list(words)
                while True:
                    words[r.randrange(len(words))] = word()
                    a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (before, words))
                    similarity = len(a & b) / len(a | b)
                    if similarity < 0.85:
                        break
                if similarity >= 0.8:
                    links.append((len(rows) - 1, len(rows)))
            rows.append((len(rows), " ".join(words)))
    assert len(links) > 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for full in (4096, 3):
        monkeypatch.setattr(ngram_join, "FULL", full)
        of = {r["doc_id"]: r["class_id"] for r in ngram_join.similar_documents(docs).collect()}
        assert np.mean([of[a] == of[b] for a, b in links]) >= 0.99


def test_groups_grow_in_any_order():
    r = np.random.default_rng(5)
    sig = r.integers(0, 256, (1, 128)).repeat(30, 0)
    for k in range(1, 30):  # a chain: each like its neighbours only
        sig[k] = sig[k - 1]
        sig[k, r.choice(128, 30, replace=False)] = r.integers(0, 256, 30)
    for _ in range(20):
        order = r.permutation(30)
        edges = np.array([(i, j) for i, j, _ in ngram_join._grown(sig[order], np.arange(30))])
        assert (ngram_join._roots(30, edges) == 0).all()


def test_radius_leaves_out_few(spark):
    """Pairs of item-sized windows at a similarity of 0.80 to 0.81: how many fingerprints are farther apart than the radius."""
    r = np.random.default_rng(3)
    rows = []
    for k in range(4000):
        m = int(r.integers(20, 200))
        kept = int(np.ceil(0.8 * 2 * m / 1.8))
        a = r.integers(-(2**63), 2**63 - 1, m)
        b = np.concatenate([a[:kept], r.integers(-(2**63), 2**63 - 1, m - kept)])
        rows.append((k, a.tolist(), b.tolist()))
    pairs = spark.createDataFrame(rows, "k bigint, a array<bigint>, b array<bigint>").repartition(4)
    f = lambda c: pairs.selectExpr("k", f"{c} as s").selectExpr("k", f"{decontaminate._FINGERPRINT} as f_{c}")
    far = f("a").join(f("b"), "k").selectExpr("bit_count(f_a ^ f_b) as d").filter(f"d > {decontaminate.RADIUS}").count()
    assert far <= 0.005 * len(rows), far
