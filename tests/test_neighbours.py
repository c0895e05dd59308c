"""Bucketed neighbour search against the exact one."""

from __future__ import annotations

import numpy as np

from sessionlens.operators import neighbours as N


def test_buckets_hold_about_as_many_items_at_any_size():
    for items in (1000, 100_000, 10_000_000):
        assert 128 <= items / 2 ** N.lsh_bits(items, 256) <= 256
    assert N.lsh_bits(0, 256) == N.lsh_bits(5, 256) == 1


def test_recall_against_exact_search(spark):
    """Items in 150 clusters: nine of ten of the exact neighbours are found."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((150, 24))
    rows = [(i, [float(x) for x in centres[i % 150] + 0.3 * rng.standard_normal(24)]) for i in range(3000)]
    vectors = spark.createDataFrame(rows, "aid long, vector array<float>")
    exact = {(r["aid_x"], r["aid_y"]) for r in N.item_knn(vectors, k=10).collect()}
    found = {(r["aid_x"], r["aid_y"]) for r in N.item_knn_lsh(vectors, k=10).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    few = spark.createDataFrame([(1,), (2,), (2,)], "aid long")
    assert {r["aid_x"] for r in N.item_knn_lsh(vectors, few, k=10).collect()} == {1, 2}


def test_tables_keep_recall_as_planes_grow(spark):
    """Loose clusters (cosine about 0.7) in 256 buckets: twelve tables would find about seven of ten neighbours."""
    for items in (500, 8_192, 100_000, 1_860_000, 10_000_000):
        bits = N.lsh_bits(items, 256)
        odds = (1 - np.arccos(0.7) / np.pi) ** bits
        assert 1 - (1 - odds) ** max(12, N.lsh_tables(bits, 0.9, 0.7)) >= 0.9
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((200, 48))
    rows = [(i, [float(x) for x in centres[i % 200] + 0.65 * rng.standard_normal(48)]) for i in range(4000)]
    vectors = spark.createDataFrame(rows, "aid long, vector array<float>")
    exact = {(r["aid_x"], r["aid_y"]) for r in N.item_knn(vectors, k=10).collect()}
    found = {(r["aid_x"], r["aid_y"]) for r in N.item_knn_lsh(vectors, k=10, per_bucket=16).collect()}
    assert len(exact & found) / len(exact) >= 0.9
