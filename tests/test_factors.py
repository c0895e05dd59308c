"""Vectors learned from structured logs: items of one group must find each other."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.operators import factors as Z
from sessionlens.operators.models import interaction_factors

GROUPS, PER = 12, 10


@pytest.fixture(scope="module")
def log(spark):
    """Sessions that stay in one of 12 groups of ten items, but for one step in ten."""
    rng, rows = random.Random(3), []
    for s in range(400):
        g = rng.randrange(GROUPS)
        for k in range(rng.randint(4, 12)):
            aid = rng.randrange(GROUPS * PER) if rng.random() < 0.1 else g * PER + min(PER - 1, int(rng.expovariate(0.4)))
            rows.append((s, aid, k * 1000, "clicks"))
    return spark.createDataFrame(rows, "session long, aid long, ts long, type string").cache()


def purity(vectors):
    """Share of the five nearest items of each item that are of its group."""
    rows = vectors.collect()
    ids, v = np.array([r["aid"] for r in rows]), np.array([r["vector"] for r in rows], float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    near = v @ v.T
    np.fill_diagonal(near, -2)
    return np.mean([(ids[np.argsort(-n)[:5]] // PER == i // PER).mean() for i, n in zip(ids, near)])


def test_skip_gram_matrix_and_its_factors(spark, log):
    pairs = Z.window_pairs(log, 25)
    both = pairs.union(pairs.select("aid_near", "aid", "n")).groupBy("aid", "aid_near").agg(F.sum("n").alias("n"))
    cells = Z.staged(Z.shifted_pmi(both))
    n = {(r["aid"], r["aid_near"]): r["n"] for r in both.collect()}
    left, right = {}, {}
    for (a, b), c in n.items():
        left[a], right[b] = left.get(a, 0) + c, right.get(b, 0) + c
    total = sum(c**0.75 for c in right.values())
    want = {(a, b): np.log(c * total / (left[a] * right[b] ** 0.75)) for (a, b), c in n.items()}
    got = {(r["aid"], r["aid_near"]): r["pmi"] for r in cells.collect()}
    assert set(got) == {k for k, x in want.items() if round(x, 6) > 0} and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    ids = sorted(left)
    m = np.zeros((len(ids), len(ids)))
    for (a, b), x in got.items():
        m[ids.index(a), ids.index(b)] = x
    u, s, _ = np.linalg.svd(m)
    exact = (u[:, :8] * s[:8]) @ u[:, :8].T  # does not depend on signs
    rows = {r["aid"]: r["vector"] for r in Z.factorised(cells, 8).collect()}
    mine = np.array([rows[i] for i in ids])
    assert np.abs(mine @ mine.T - exact).max() < 0.05 * s[0]
    assert purity(Z.skip_gram_vectors(log, 16)) > 0.9


def test_warp_finds_held_out_items_as_well_as_implicit_als(spark, log):
    pairs = log.select("session", "aid").distinct()
    held = pairs.where(F.pmod(F.xxhash64("session", "aid"), F.lit(5)) == 0)
    train = pairs.join(held, ["session", "aid"], "left_anti").cache()

    def precision(sessions, items):
        u = {r["session"]: np.array(r["vector"], float) for r in sessions.collect()}
        rows = items.collect()
        ids, v = [r["aid"] for r in rows], np.array([r["vector"] for r in rows], float)
        seen, want = {}, {}
        for r in train.collect():
            seen.setdefault(r["session"], set()).add(r["aid"])
        for r in held.collect():
            want.setdefault(r["session"], set()).add(r["aid"])
        hits = []
        for s, own in want.items():
            if s in u:
                order = [ids[k] for k in np.argsort(-(v @ u[s])) if ids[k] not in seen.get(s, ())]
                hits.append(len(own & set(order[:10])) / 10)
        return np.mean(hits)

    first = Z.warp_vectors(train, size=16, epochs=12, step=0.1, blocks=2, reg=0.3)
    again = Z.warp_vectors(train.repartition(5), size=16, epochs=12, step=0.1, blocks=2, reg=0.3)
    key = lambda t: sorted((r[0], tuple(r[1])) for r in t.collect())
    assert key(first[1]) == key(again[1])  # whatever the partitioning
    als = interaction_factors(train.withColumn("n", F.lit(1)), rank=16, epochs=10, blocks=2)
    one = first[0].limit(1)
    popular = train.groupBy("aid").count().select("aid", F.array(F.col("count").cast("double")).alias("vector"))
    same = train.select("session").distinct().select("session", F.array(F.lit(1.0)).alias("vector"))
    mine = precision(*first)
    assert mine > 2 * precision(same, popular) and mine > 0.9 * precision(*als) and len(one.first()["vector"]) == 17


def test_both_sides_of_a_pair_move_one_table(spark, log):
    moves = Z.staged(Z.move_counts(log).withColumnRenamed("moves", "n"))
    wrong = moves.where("aid != aid_next").select("aid", "aid_next", F.pmod(F.col("aid_next") + 57, F.lit(GROUPS * PER)).alias("aid_wrong"))
    vectors, curve = Z.pair_vectors(moves, 16, epochs=6, blocks=4, valid=wrong)
    assert curve[-1] > 0.65 and curve[-1] > curve[0] + 0.05 and len(curve) == 6  # a third of the distinct moves are random steps
    assert purity(vectors) > 0.6
    assert vectors.count() == moves.select(F.explode(F.array("aid", "aid_next"))).distinct().count()


def test_rounds_meet_every_pair_once():
    for blocks in (2, 4, 10):
        rounds = Z._rounds(blocks)
        met = [p for r in rounds for p in r]
        assert sorted(met) == [(i, j) for i in range(blocks) for j in range(i, blocks)]
        assert all(len({b for p in r for b in p}) == sum(len(set(p)) for p in r) for r in rounds)
