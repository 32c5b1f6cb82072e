"""Hierarchies as tables against dense least squares and plain walks."""

import random

import numpy as np
import pytest

from tidemark.operators import hierarchy


def tree(spark, parents):
    return spark.createDataFrame(list(parents.items()), "node string, parent string").repartition(3)


def grown(n, seed, deep=False):
    r = random.Random(seed)
    return {"0": None} | {str(k): str(r.randrange(max(0, k - 3), k) if deep else r.randrange(k)) for k in range(1, n)}


@pytest.mark.parametrize("deep", [False, True])
def test_depths_and_ancestors(spark, deep):
    parents = grown(60, 1, deep) | {"other": None, "o1": "other"}

    def up(node):
        while node is not None:
            yield node
            node = parents[node]

    got = {r["node"]: r for r in hierarchy.depths(tree(spark, parents)).collect()}
    for node in parents:
        walk = list(up(node))
        assert (got[node]["depth"], got[node]["top"], got[node]["children"]) == (len(walk) - 1, walk[-1], sum(p == node for p in parents.values()))
    pairs = [(r["node"], r["ancestor"], r["distance"]) for r in hierarchy.ancestors(tree(spark, parents)).collect()]
    assert sorted(pairs) == sorted((n, a, k) for n in parents for k, a in enumerate(up(n)))
    leaves = spark.createDataFrame([(n, float(k)) for k, n in enumerate(parents)], "node string, value double")
    sums = {r["node"]: r["value"] for r in hierarchy.roll_up_tree(leaves, tree(spark, parents)).collect()}
    assert sums == {n: sum(float(k) for k, m in enumerate(parents) if n in up(m)) for n in parents}


def test_refused_trees(spark):
    for parents, told in (({"a": "b", "b": "a", "c": None}, "cycle"), ({"a": "a"}, "cycle"), ({"a": "x"}, "no row")):
        with pytest.raises(ValueError, match=told):
            hierarchy.depths(tree(spark, parents))
    with pytest.raises(ValueError, match="several rows"):
        hierarchy.depths(spark.createDataFrame([("a", None), ("a", None)], "node string, parent string"))


def test_reconciled_equals_least_squares(spark):
    """Ten levels, nodes without a forecast, variances; a second tree that lacks a leaf at one step."""
    parents = {"r": None}
    for level in range(1, 10):
        above = [n for n in parents if n.count(".") == level - 1]
        r = random.Random(level)
        for n in above[: 6 if level > 3 else None]:
            parents |= {f"{n}.{k}": n for k in range(r.randint(1, 3))}
    parents |= {"q": None, "q1": "q", "q2": "q"}
    leaves = [n for n in parents if n not in parents.values()]
    rng = np.random.default_rng(0)
    spread = {n: float(rng.uniform(0.5, 4)) for n in parents}
    base = [(n, h, float(rng.normal(50, 20))) for n in parents for h in (1, 2) if not (n in ("r.0", "r.0.0") or n == "q1" and h == 2)]
    got = hierarchy.reconcile_tree(spark.createDataFrame(base, "node string, h int, point double"), tree(spark, parents), spark.createDataFrame(list(spread.items()), "node string, variance double"))
    rows = {(r["node"], r["h"]): r["reconciled"] for r in got.collect()}
    assert len(rows) == 2 * len(parents)

    def below(node):
        return [x for x in leaves if x == node or any(a == node for a in walk(x))]

    def walk(node):
        while (node := parents[node]) is not None:
            yield node

    for h in (1, 2):
        own = {n: p for n, k, p in base if k == h}
        names = [n for n in parents if not (h == 2 and n.startswith("q"))]
        used = [x for x in leaves if x in names]
        s = np.array([[x in below(n) for x in used] for n in names if n in own], float)
        w = np.array([1 / spread[n] for n in names if n in own])
        y = np.array([own[n] for n in names if n in own])
        beta = np.linalg.solve(s.T @ (w[:, None] * s), s.T @ (w * y))
        for n in names:
            assert rows[n, h] == pytest.approx(sum(b for b, x in zip(beta, used, strict=True) if x in below(n)))
    assert [rows[n, 2] for n in ("q", "q1", "q2")] == [None] * 3
    gaps = hierarchy.coherence(got.filter("h = 1"), tree(spark, parents)).collect()
    assert gaps and max(abs(g["gap"]) for g in gaps) < 1e-8
    empty = spark.createDataFrame([], "node string, h int, point double")
    assert hierarchy.reconcile_tree(empty, spark.createDataFrame([], "node string, parent string")).count() == 0
