import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.llm import rpforest

QUERY = "vec_id % 100 = 0"


def exact(rows, k=10):
    """(query, rank) -> (id, distance) by brute force; rows: (id, vector)."""
    rows = [(i, v) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows)]
    out = {}
    for q, v in rows:
        if q % 100 == 0:
            near = sorted((math.dist(v, w), i) for i, w in rows if i != q)[:k]
            out |= {(q, r): (i, d) for r, (d, i) in enumerate(near, 1)}
    return out


def as_found(df):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, (i, d) in want.items():
        assert got[key][0] == i and got[key][1] == pytest.approx(d, abs=1e-12)


def test_ties_repeats_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(1, 400)]
    good = [(i, v) for i, v in good if any(v)]
    good += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(400, 700)] + good[:50]
    bad = [(1000, None), (1001, [0.0] * 4), (1100, [1.0, None, 1.0, 1.0]), (1200, [float("nan"), 1.0, 1.0, 1.0]), (1300, [float("inf"), 1.0, 1.0, 1.0]), (1400, []), (1500, [1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    same(as_found(rpforest.nearest(df, F.expr(QUERY), search_rows=10**6, leaf_rows=30, block_rows=20)), exact(good))


def test_fewer_than_k_and_empty(spark):
    rows = [(100, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [3.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same(as_found(rpforest.nearest(df, F.expr(QUERY))), exact(rows))
    assert rpforest.nearest(df.where("vec_id = 100"), F.expr(QUERY)).count() == 0
    assert rpforest.nearest(df.where("vec_id = 0"), F.expr(QUERY)).count() == 0


def test_recall_with_the_production_search(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = as_found(rpforest.nearest(df, F.expr(QUERY))), exact(rows)
    hits = sum(i in {got[q, r][0] for r in range(1, 11)} for (q, _), (i, _) in want.items())
    assert hits / len(want) >= 0.9


def test_search_meets_leaves_best_first():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 8))
    forest = rpforest.fit(x, 3, 4)
    sizes = np.stack([np.bincount(forest.leaves(x)[:, t], minlength=16) for t in range(3)])
    assert [t.tolist() for t in forest.cut(2).leaves(x).T] == [(t // 4).tolist() for t in forest.leaves(x).T]
    met = forest.search(x[0], sizes, 10**9)
    assert sorted(met) == [(t, n) for t in range(3) for n in range(16) if sizes[t, n]]
    assert set(met[:3]) == {(t, int(n)) for t, n in enumerate(forest.leaves(x[:1])[0])}


def test_lengths_are_searched_apart(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3 if i % 3 else 5).tolist()) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = exact([r for r in rows if len(r[1]) == 3]) | exact([r for r in rows if len(r[1]) == 5])
    same(as_found(rpforest.nearest(df, F.expr(QUERY))), want)


def test_a_vector_that_many_queries_share(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "SAME_ROWS", 4)
    rng = np.random.default_rng(7)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.integers(0, 4, 3).astype(float).tolist()) for i in range(6000)]
    rows = [(i, v) for i, v in rows if any(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(as_found(rpforest.nearest(df, F.expr(QUERY), leaf_rows=10)), exact(rows))


def test_search_follows_the_structure_of_the_vectors():
    rng = np.random.default_rng(8)
    loose = rng.normal(size=(20_000, 32))
    tight = rng.normal(size=(200, 32))[rng.integers(0, 200, 20_000)] * 10 + rng.normal(size=(20_000, 32)) * 0.1
    needed = []
    for x in (loose, tight):
        forest = rpforest.fit(x[:8000], 4, 6)
        sizes = np.stack([np.bincount(forest.leaves(x)[:, t], minlength=64) for t in range(4)])
        near = [x[np.argsort(np.linalg.norm(x - p, axis=1))[1:11]] for p in x[:30]]
        n = rpforest.needed_rows(forest, sizes, x[:30], near)
        needed.append(n)
        hits = [any((t, int(leaf)) in set(forest.search(p, sizes, n)) for t, leaf in enumerate(row)) for p, of in zip(x[:30], near, strict=True) for row in forest.leaves(of)]
        assert np.mean(hits) >= 0.95
    assert needed[1] < needed[0] / 8
