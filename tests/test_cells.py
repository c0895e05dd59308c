"""The inverted file against exact search."""

from __future__ import annotations

import numpy as np
import pytest

from sessionlens.operators import neighbours as N


def frame(spark, points):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points.astype(np.float32))], "aid long, vector array<float>")


def rows(df):
    return sorted(map(tuple, df.select("aid_x", "n", "aid_y", "dist").collect()))


def clusters(items, groups, spread, size=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, size))
    return centres[rng.integers(0, groups, items)] + spread * rng.standard_normal((items, size))


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_equal_to_exact_search(spark, kind):
    points = {"clusters": clusters(1200, 40, 0.3), "noise": clusters(600, 600, 1.0), "copies": clusters(500, 20, 0.4)}[kind]
    if kind == "copies":
        points[300:] = points[7]  # and one that has no direction
        points[11] = 0
    vectors = frame(spark, points)
    assert rows(N.item_knn_cells(vectors, k=10, block=64)) == rows(N.item_knn(vectors, k=10))


def test_some_queries_and_small_tables(spark):
    vectors = frame(spark, clusters(300, 9, 0.3))
    some = spark.createDataFrame([(3,), (3,), (999,)], "aid long")
    assert rows(N.item_knn_cells(vectors, some, k=5)) == rows(N.item_knn(vectors, some, k=5))
    few = vectors.where("aid < 3")
    assert rows(N.item_knn_cells(few, k=5)) == rows(N.item_knn(few, k=5))
    assert N.item_knn_cells(vectors.limit(0), k=5).count() == 0


def test_recall_of_the_nearest_cells(spark):
    """Loose clusters (cosine about 0.7): as many cells as a sample of queries asks for find nine of ten neighbours."""
    vectors = frame(spark, clusters(3000, 100, 0.65, size=48))
    exact = {(r[0], r[2]) for r in rows(N.item_knn(vectors, k=20))}
    cells = N.Cells(vectors)
    assert cells.rows.count() == 3000  # every vector once
    probes = cells.probes_for(0.9, 20)
    assert probes < len(cells.centres)
    found = {(r[0], r[2]) for r in rows(N.item_knn_cells(vectors, k=20, recall=0.92))}
    assert len(exact & found) / len(exact) >= 0.9


@pytest.mark.parametrize("search", [N.item_knn, N.item_knn_cells])
def test_what_is_shuffled_grows_as_the_table(spark, monkeypatch, search):
    """Noise, where no cell can be left out: rows that leave the kernels are bounded for each query, whatever the number of blocks."""
    offered, top_n = [], N.top_n

    def counted(rows_, *args, **more):
        offered.append(rows_.count())
        return top_n(rows_, *args, **more)

    monkeypatch.setattr(N, "top_n", counted)
    points = clusters(900, 900, 1.0)
    search(frame(spark, points), k=5, block=16)
    assert max(offered) <= 900 * 5 * (N.LANES + 1)


def test_lots_and_lanes():
    assert N.grid_size(100, 100) == (1, 1) and N.grid_size(0, 0) == (1, 1)
    assert N.grid_size(10_000, 10_000) == N.grid_size(1_000_000, 1_000_000) == (N.LOTS, N.LANES)
    lots, _ = N.grid_size(100_000_000, 100_000_000)
    assert 100_000_000 / lots <= N.LOT_MOST


def test_queries_of_one_cell_in_several_lots(spark):
    """More copies of a vector than a lot holds, all in one cell."""
    points = clusters(1500, 30, 0.4)
    points[200:1100] = points[5]
    vectors = frame(spark, points)
    cells = N.Cells(vectors)
    asked, lots, _ = cells.lots_of(cells.rows)
    assert asked.groupBy("lot").count().agg({"count": "max"}).first()[0] < 1500 / lots * 3
    assert rows(N.item_knn_cells(vectors, k=6)) == rows(N.item_knn(vectors, k=6, block=100))
