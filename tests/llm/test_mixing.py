from __future__ import annotations

import numpy as np
import pytest

from sessionlens.llm.mixing import mix, paired, pooled, source_targets, take_mix


def targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, cap, share what is over among the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * share > most * sizes[s]}
        if not over:
            out |= {s: w[s] * share for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1, "d": 0, "é": 50, None: 7}, {"x": 5}, {"a": 0, "b": 0}, {"a": 1, "b": 100, "c": 10_000}])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, n long")
    got = {r["source"]: r["target"] for r in source_targets(table).collect()}
    assert got == pytest.approx(targets(sizes))


def test_pivotal_steps_keep_sums_and_expectations():
    rng = np.random.default_rng(1)
    mass, chances = np.sort(rng.integers(1, 3000, 30).astype(float))[::-1], rng.random(30)
    for draw, chance, each in ((paired, chances, chances), (pooled, 0.3, np.full(30, 0.3))):
        total = np.zeros(30)
        for _ in range(4000):
            ends, held = draw(mass, chance, rng.random(30))
            open_ = np.flatnonzero((ends > 0) & (ends < 1))
            assert list(open_) == ([held] if held >= 0 else [])
            assert (ends * mass).sum() == pytest.approx((each * mass).sum())
            total += ends
        assert np.abs(total / 4000 - each).max() < 0.05


def test_every_source_ends_near_its_target(spark):
    rng = np.random.default_rng(2)
    rows = []
    for source, n in (("hot", 6000), ("b", 900), ("c", 40), (None, 300)):
        for _ in range(n):
            rows.append((len(rows), " ".join(["w"] * int(rng.integers(1, 60))), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mix(docs).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.told).all() and (abs(by.taken - by.target) <= 60).all()
    again = mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "size"]
    assert got.sort_values(key)["taken"].tolist() == again.sort_values(key)["taken"].tolist()


def test_edge_cases(spark):
    rows = [(1, "a b", "s", 0), (1, "a b", "s", 0), (None, "c d e", "s", 0), (2, None, "s", 0), (3, "", None, 0), (4, " \t", "only blank", 0), (5, "x " * 100_000, "long", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(docs).toPandas()
    assert got["rows"].sum() == len(rows)
    assert (got[got["size"] == 0].taken == 0).all() and (got[got["size"] == 0].copies == 0).all()
    assert got[got.source == "only blank"].target.tolist() == [0.0]
    kept = take_mix(docs)
    assert kept.columns == ["doc_id", "text", "source", "size", "copies", "taken", "source_size", "target"]
    both = [r["copies"] for r in kept.collect() if r["doc_id"] == 1]
    assert len(both) in (0, 2) and len(set(both)) <= 1  # repeated rows are taken alike
    assert mix(docs.limit(0)).count() == 0 and take_mix(docs.limit(0)).count() == 0
