from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.functions import vectors as V
from sessionlens.operators import distance
from sessionlens.operators.blocks import block_keys
from sessionlens.operators.distance import session_item_distance
from sessionlens.operators.neighbours import item_knn, item_knn_lsh


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    m = rng.standard_normal((60, 8)).astype(np.float32)
    m[40:] = m[7]  # a third of all items are copies of one
    return m


@pytest.fixture(scope="module")
def vectors(spark, table):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "aid long, vector array<float>")


def distances(table):
    unit = V.normalise(table.astype(np.float64))
    return np.round(V.angular(unit, unit), 6)


@pytest.mark.parametrize("block", [7, 1000])
def test_knn_equals_brute_force(vectors, table, block):
    want = distances(table)
    got = {}
    for r in sorted(item_knn(vectors, k=6, block=block).collect(), key=lambda r: r["n"]):
        got.setdefault(r["aid_x"], []).append(r["aid_y"])
    for i in range(len(table)):
        assert got[i] == sorted(range(len(table)), key=lambda j: (want[i, j], j))[:6]


def test_knn_of_some_items(spark, vectors):
    some = spark.createDataFrame([(3,), (3,), (999,)], "aid long")
    assert {r["aid_x"] for r in item_knn(vectors, some, k=2).collect()} == {3}


def test_lsh_finds_copies_and_true_distances(vectors, table):
    want = distances(table)
    rows = item_knn_lsh(vectors, k=5, per_bucket=8, tables=4, block=9).collect()
    assert all(r["dist"] == want[r["aid_x"], r["aid_y"]] for r in rows)
    copies = [r for r in rows if r["aid_x"] >= 40]
    assert all(r["dist"] == 0 for r in copies) and len(copies) == 20 * 5


@pytest.mark.parametrize("block", [2, 256])
def test_history_distance(spark, vectors, table, events, event_rows, block):
    candidates = events.select("session").distinct().withColumn("aid", F.explode(F.array(*[F.lit(a).cast("long") for a in (1, 30, 45)])))
    want = V.angular(V.normalise(table.astype(np.float64)), V.normalise(table.astype(np.float64)))
    for r in session_item_distance(candidates, events, vectors, block=block).collect():
        d = np.array([want[r["aid"], e[1]] for e in event_rows if e[0] == r["session"]])
        assert r["score_length"] == len(d)
        got = [r["score_mean"], r["score_std"], r["score_max"], r["score_min"]]
        assert np.allclose(got, [d.mean(), d.std(), d.max(), d.min()], atol=2e-6)


def test_dot(vectors, table):
    rows = vectors.select("aid", V.dot(F.col("vector"), F.col("vector")).alias("d")).collect()
    assert np.allclose([r["d"] for r in sorted(rows)], (table.astype(np.float64) ** 2).sum(axis=1))


@pytest.mark.parametrize("part_rows", [11, 200_000])
def test_history_distance_in_parts(spark, vectors, table, monkeypatch, part_rows):
    """Keys travel and vectors only once to a part; a session over many blocks, an item without a vector and one with two."""
    monkeypatch.setattr(distance, "PART_ROWS", part_rows)
    sessions = {1: list(range(50)), 2: [3, 3, 999], 3: [998], 4: [2]}
    events = spark.createDataFrame([(s, a) for s, own in sessions.items() for a in own], "session long, aid long")
    candidates = spark.createDataFrame([(s, a) for s in (1, 2, 3, 5) for a in (*range(30), 999)] + [(None, 3), (2, None)], "session long, aid long")
    twice = vectors.union(vectors.where("aid = 3"))
    keys = block_keys(candidates.where("aid is not null"), events.withColumn("n", F.lit(1).cast("long")).distinct(), "session", "aid", 8)
    assert "vector" not in keys.columns
    assert {(r["session"], r["lb"], r["rb"]) for r in keys.where("session = 1").collect()} == {(1, i, j) for i in range(4) for j in range(7)}
    got = {(r["session"], r["aid"]): r for r in session_item_distance(candidates, events, twice, block=8).collect()}
    assert set(got) == {(s, a) for s in (1, 2) for a in range(30)}
    d = distances(table)
    for (s, a), r in got.items():
        own = [d[a, h] for h in sessions[s] if h < 60 for _ in range(2 if h == 3 else 1)] * (2 if a == 3 else 1)
        assert r["score_length"] == len(own)
        assert np.allclose([r["score_mean"], r["score_max"], r["score_min"]], [np.mean(own), max(own), min(own)], atol=2e-6)
