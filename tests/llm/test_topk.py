from __future__ import annotations

import math

import numpy as np

from sessionlens.llm import topk as K


def brute(rows, k=10, every=100):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in whole:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
    return out


def got(df, **more):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in K.top_k(df, **more).collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * rng.lognormal(0, 1, (n, 1)) * np.linspace(2, 0.1, dim)
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def test_agrees_with_brute_force(spark, monkeypatch):
    rows = vectors(900, 40, 1)
    df = frame(spark, rows).repartition(4)
    assert got(df) == brute(rows)
    monkeypatch.setattr(K, "QUERY_BLOCK", 4)  # several blocks and a short head
    monkeypatch.setattr(K, "HEAD", 20)
    assert got(df, every=50) == brute(rows, every=50)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (7, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [-1.0, 0.5]), (200, [0.0, 0.0]), (300, [1.0, 2.0, 3.0]), (8, [0.0, 1.0, 0.0]), (9, None), (10, [None, 1.0]), (11, [nan, 1.0]), (400, [inf, 1.0]), (None, [1.0, 1.0]), (500, []), (12, [])]
    assert got(frame(spark, rows), k=3) == brute(rows, k=3)
    many = [(i, [1.0, 0.0]) for i in range(300)]  # all the same: ties go to smaller ids
    assert got(frame(spark, many)) == brute(many)
    twice = frame(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])])
    rows = K.top_k(twice).collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in rows] == [(0, 1, 2048 * 1024)] * 2
    assert K.top_k(frame(spark, rows[:0])).count() == 0
    assert K.top_k(frame(spark, [(1, [1.0])])).count() == 0  # no queries
