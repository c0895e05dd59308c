"""Boosted rankers grown by histogram aggregation."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionlens.operators import boosting as B
from sessionlens.plans import ranking as R

NAMES = ["x", "noise", "odd"]


@pytest.fixture(scope="module")
def rows(spark):
    """Sessions of twelve rows, two of them good; x tells them apart, odd is missing for a third of all."""
    rng, out = random.Random(8), []
    for s in range(50):
        for a in range(12):
            x = rng.gauss(1.5 if a < 2 else 0.0, 0.8)
            out.append((s, a, x, rng.random(), None if a % 3 == 0 else rng.random(), float(a < 2), s % 5))
    return spark.createDataFrame(out, "session long, aid long, x double, noise double, odd double, gt double, fold long").cache()


def small(**more):
    return B.Boost(**{"rounds": 5, "depth": 2, "patience": 3, "least_rows": 10, "bins": 16, **more})


@pytest.mark.parametrize("objective", ["lambda", "squared", "log"])
def test_positives_come_first(spark, rows, objective):
    fitted, lists = B.fit_boosted({"carts": rows}, NAMES, small(objective=objective))
    scored = fitted.held_out(lists).cache()
    assert scored.count() == 600 and scored.select("session", "aid").distinct().count() == 600
    assert R.auc(scored) > 0.85
    assert R.held_out_ndcg(scored).first()["ndcg"] > 0.8
    assert all(fitted.names[f] == "x" for f, *_ in fitted.first_splits.values())


def test_first_split_equals_brute_force(spark, rows):
    fitted, _ = B.fit_boosted({"carts": rows}, NAMES, small(rounds=1, depth=1), folds=5)
    table = rows.toPandas().sort_values(["session", "aid"])
    edges = fitted.edges["carts"]
    x = B.binned(table[NAMES].to_numpy(float), edges)
    place, y = table["aid"].to_numpy(), table["gt"].to_numpy()
    ideal = 1 + 1 / np.log2(3)
    g, h = np.zeros(len(y)), np.zeros(len(y))
    for s in range(50):
        own = np.arange(12) + 12 * s
        for p in own[:2]:
            for q in own[2:]:
                change = abs(1 / np.log2(place[p] + 2) - 1 / np.log2(place[q] + 2)) / ideal
                g[p], g[q], h[p], h[q] = g[p] - change / 2, g[q] + change / 2, h[p] + change / 4, h[q] + change / 4
    g, h = np.rint(g * B.UNIT) / B.UNIT, np.rint(h * B.UNIT) / B.UNIT
    for fold in range(5):
        train, best = (table["fold"] != fold).to_numpy(), (-1, None)
        for f in range(3):
            for cut in range(17):
                left = train & (x[:, f] <= cut)
                right = train & ~left
                if left.sum() >= 10 and right.sum() >= 10:
                    gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, right)) - g[train].sum() ** 2 / (h[train].sum() + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, cut, round(gain, 6), left.sum(), right.sum()))
        got = fitted.first_splits["carts", fold]
        assert got[:2] == best[1][:2] and got[3:] == best[1][3:] and abs(got[2] - best[1][2]) < 2e-6


def test_the_same_on_any_partitioning_and_with_scores_written_out(spark, rows, monkeypatch):
    trees = lambda fitted: [(m, [(t.feature.tolist(), t.cut.tolist(), t.value.tolist()) for t in own]) for m, own in fitted.trees.items()]
    one, _ = B.fit_boosted({"carts": rows}, NAMES, small(rounds=4))
    monkeypatch.setattr(B, "KEEP", 2)
    two, _ = B.fit_boosted({"carts": rows.repartition(7)}, NAMES, small(rounds=4))
    assert trees(one) == trees(two) and one.curves == two.curves


def test_patience_and_best_round(spark, rows):
    """Nothing to learn: models stop when patience ends, and keep their best round only."""
    fitted, _ = B.fit_boosted({"carts": rows}, ["noise"], small(rounds=30, patience=2))
    for model, curve in fitted.curves.items():
        best = fitted.best_round(model)
        assert curve[best] == max(curve[1:]) and len(curve) - 1 == min(30, best + 2)
        assert len(fitted.kept(model)) == best
    table = fitted.curve(spark)
    assert table.where("best").count() == 5 and set(table.columns) == {"type", "fold", "round", "ndcg", "best"}


def test_all_models_in_one_pass(spark, rows):
    fitted, lists = B.fit_boosted({"carts": rows, "orders": rows.where("aid < 9")}, NAMES, small(rounds=2))
    scores = fitted.fold_scores(rows)
    assert scores.count() == 600 * 10
    assert scores._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") == 1
    held = {(r["session"], r["aid"]): r["score"] for r in fitted.held_out(lists).where("type = 'carts'").collect()}
    whole = {(r["session"], r["aid"], r["fold"]): r["score"] for r in scores.where("type = 'carts'").collect()}
    assert all(abs(held[s, a] - whole[s, a, s % 5]) < 1e-12 for s, a in held)


def test_long_sessions_are_several_lists(spark, rows, monkeypatch):
    monkeypatch.setattr(B, "LIST_ROWS", 5)
    fitted, lists = B.fit_boosted({"carts": rows}, NAMES, small(rounds=1))
    assert lists.count() > 50 and fitted.held_out(lists).count() == 600


@pytest.mark.parametrize("cells", [0, 1 << 26])
def test_parts_of_a_session_learn_as_one_list(spark, rows, monkeypatch, cells):
    """Trees, curves and scores are the same whether sessions are stored whole or in parts, and whatever pieces they are worked on in."""
    trees = lambda fitted: [(m, [(t.feature.tolist(), t.cut.tolist(), t.value.tolist()) for t in own]) for m, own in fitted.trees.items()]
    held = lambda fitted, lists: sorted(map(tuple, fitted.held_out(lists).collect()))
    monkeypatch.setattr(B, "TASK_CELLS", cells)
    one = B.fit_boosted({"carts": rows}, NAMES, small(rounds=3))
    monkeypatch.setattr(B, "LIST_ROWS", 5)
    monkeypatch.setattr(B, "PIECE", 30)
    two = B.fit_boosted({"carts": rows}, NAMES, small(rounds=3))
    assert two[1].where("parts > 1").count() > 50
    assert trees(one[0]) == trees(two[0]) and one[0].curves == two[0].curves and held(*one) == held(*two)


@pytest.mark.parametrize("more", [{}, {"objective": "log", "columns": 0.5}, {"rounds": 12, "patience": 2, "depth": 3}])
def test_models_grown_in_a_task_equal_those_grown_by_level(spark, rows, monkeypatch, more):
    """Of two types, one in a task for each model and one by levels, or both: trees, curves and first splits are the same."""
    copies = {"same": F.col("x"), "still": F.lit(3.0)}
    training = {"carts": rows.withColumns(copies), "orders": rows.where("aid < 9").withColumns(copies)}
    names, found = ["same", *NAMES, "still"], []
    for cells in (1 << 26, 500 * len(names), 0):
        monkeypatch.setattr(B, "TASK_CELLS", cells)
        fitted, _ = B.fit_boosted(training, names, small(**{"rounds": 3, **more}))
        trees = {m: [(t.feature.tolist(), t.cut.tolist(), t.value.tolist()) for t in own] for m, own in fitted.trees.items()}
        found.append((trees, fitted.curves, fitted.first_splits))
    assert found[0] == found[1] == found[2] and len(found[0][0]) == 10


def test_small_types_take_no_job_for_a_level(spark, rows, monkeypatch):
    monkeypatch.setattr(B, "best_splits", None)
    fitted, _ = B.fit_boosted({"carts": rows}, NAMES, small(rounds=40, patience=40))
    assert all(len(own) == 40 for own in fitted.trees.values())


def _stored(sessions):
    """A batch of stored parts (session, aids, labels), one feature, in fold 0 of one."""
    schema = pa.schema([("type", pa.string()), ("session", pa.int64()), ("fold", pa.int32()), ("aid", pa.list_(pa.int64())), ("gt", pa.list_(pa.int32())), ("x", pa.list_(pa.binary())), ("base", pa.list_(pa.float64()))])
    return pa.RecordBatch.from_pylist([{"type": "carts", "session": s, "fold": 0, "aid": a, "gt": y, "x": [b"\x00"] * len(a), "base": [0.0] * len(a)} for s, a, y in sessions], schema)


def test_pieces_hold_whole_sessions(monkeypatch):
    monkeypatch.setattr(B, "PIECE", 4)
    parts = [(s, [3 * p, 3 * p + 1, 3 * p + 2], [0, 0, 1]) for s in range(6) for p in range(1 + s % 3)]
    for size in (1, 2, 5, 20):
        pieces = list(B._pieces(iter([_stored(parts[i : i + size]) for i in range(0, len(parts), size)])))
        seen = [s for piece in pieces for s in sorted(set(piece.column("session").to_pylist()))]
        assert seen == list(range(6)) and sum(piece.num_rows for piece in pieces) == len(parts) and len(pieces) > 2


@pytest.mark.parametrize("unit", [7, 1 << 20])
def test_pairs_of_a_parted_session_equal_brute_force(monkeypatch, unit):
    """One of a pair stands among the first k of its whole session; the two may lie in different parts."""
    monkeypatch.setattr(B, "UNIT", unit)
    rng = np.random.default_rng(5)
    aids, y, score = rng.permutation(40), (rng.random(40) < 0.3).astype(int), rng.normal(size=40)
    parts = [(8, aids[:15], y[:15]), (8, aids[15:30], y[15:30]), (9, aids[30:], y[30:])]
    own = B._Lists(_stored([(s, a.tolist(), b.tolist()) for s, a, b in parts]), 1)
    g, h = own._lambdas(score, np.full(40, True), 5)
    want = np.zeros((2, 40))
    for rows in (np.arange(30), np.arange(30, 40)):
        place = {r: i for i, r in enumerate(sorted(rows, key=lambda r: (-score[r], aids[r])))}
        ideal = sum(1 / np.log2(i + 2) for i in range(min(5, y[rows].sum())))
        for p in rows[y[rows] > 0]:
            for q in rows[y[rows] == 0]:
                if min(place[p], place[q]) < 5:
                    change = abs(1 / np.log2(place[p] + 2) - 1 / np.log2(place[q] + 2)) / ideal
                    rho = 1 / (1 + np.exp(score[p] - score[q]))
                    want[:, p] += (-rho * change, rho * (1 - rho) * change)
                    want[:, q] += (rho * change, rho * (1 - rho) * change)
    assert np.allclose(g, want[0]) and np.allclose(h, want[1])


def test_linear_models_in_one_pass(spark, rows):
    from sessionlens.operators.models import PairwiseRanker

    labels = rows.where("gt = 1").select("session", F.lit("carts").alias("type"), "aid")
    plain = rows.drop("gt", "fold")
    fitted = R.fit_types({"carts": plain}, labels, PairwiseRanker, ["x", "noise"])
    models = {"carts": [m for m, _ in fitted["carts"]]}
    got = {(r["session"], r["aid"], r["fold"]): r["score"] for r in R.fold_scores(plain, models, ["x", "noise"]).collect()}
    wide = R.vectorised(plain, ["x", "noise"], R.KEYS)
    for i, model in enumerate(models["carts"]):
        assert all(abs(got[r["session"], r["aid"], i] - r["score"]) < 1e-9 for r in model.score(wide).collect())


def test_cells_a_feature_at_a_time():
    """The sums of a piece equal a loop over its rows, also of a share of rows and features."""
    rng = np.random.default_rng(3)
    x, node, g, h = rng.integers(0, 17, (60, 5)).astype(np.uint8), rng.integers(0, 3, 60), rng.integers(-9, 9, 60), rng.integers(0, 9, 60)
    for rows, used in ((np.arange(60), np.arange(5)), (np.arange(0, 60, 3), np.array([1, 4]))):
        sums, want = np.zeros((3, 3, len(used), 17), np.int64), np.zeros((3, 3, len(used), 17), np.int64)
        B._add_cells(sums, node[rows], np.ascontiguousarray(x.T), rows, used, g[rows].astype(float), h[rows].astype(float))
        for r in rows:
            for i, f in enumerate(used):
                want[:, node[r], i, x[r, f]] += (g[r], h[r], 1)
        assert (sums == want).all()
