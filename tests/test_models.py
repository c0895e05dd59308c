from __future__ import annotations

import random

import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.operators import models as Z
from sessionlens.operators.sampling import folds, interaction_matrix
from sessionlens.operators.timeline import with_positions
from sessionlens.plans import ranking as R
from sessionlens.sources import sinks


@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(8)
    rows = []
    for s in range(60):
        for a in range(12):
            good = a < 2
            x = rng.gauss(2.0 if good else 0.0, 0.5)
            rows.append((s, a, x, rng.random() if a % 3 else None, float(good)))
    return spark.createDataFrame(rows, "session long, aid long, x double, noise double, gt double")


@pytest.fixture(scope="module")
def labels(training):
    return training.filter("gt = 1").select("session", F.lit("carts").alias("type"), "aid")


@pytest.mark.parametrize(
    "make",
    [Z.PairwiseRanker, lambda: Z.BoostedRanker(rounds=5, depth=2), lambda: Z.BoostedRanker(True, rounds=5, depth=2)],
)
def test_rankers_put_positives_first(training, labels, make):
    rows = R.prepared(training, ["x", "noise"])
    fitted = R.fit_folds(rows, make, n=2)
    scored = [s for _, s in fitted]
    assert all(R.auc(s) > 0.9 for s in scored)
    table = R.out_of_fold_recall(scored, labels, "carts")
    assert table.filter("fold is null").first()["recall"] == 1.0


def test_pairs_are_linear_in_negatives(training):
    rows = Z.vectorised(training, ["x"], ["session", "aid", "gt"])
    assert Z.PairwiseRanker.pairs(rows).count() == training.filter("gt = 0").count()


def test_cross_validation_and_prediction(training, labels):
    rows = training.drop("gt")
    fitted, recalls = R.cross_validate({"carts": rows}, labels, Z.PairwiseRanker, ["x", "noise"], single=True)
    assert recalls.filter("fold is null").count() == 1
    out = R.predict(rows, fitted, ["x", "noise"])
    assert out.count() == 60


def test_missing_values_are_flagged(training):
    row = Z.vectorised(training.filter("noise is null"), ["noise"], ["session"]).first()
    assert list(row["features"]) == [-1.0, 1.0]


def test_embeddings(events):
    vectors = Z.window_vectors(events, size=4, epochs=2)
    items = events.select("aid").distinct().count()
    assert vectors.count() == items and len(vectors.first()["vector"]) == 4
    sessions, by_item = Z.interaction_factors(interaction_matrix(events), rank=3, epochs=2)
    assert by_item.count() == items
    assert len(by_item.first()["vector"]) == 3
    wide = Z.session_embedding_columns(sessions, 3)
    assert wide.columns == ["session", "session_embedding0", "session_embedding1", "session_embedding2"]
    assert Z.next_item_factors(events, rank=2, epochs=1).count() > 0


def test_model_files(training, tmp_path):
    ranker = Z.PairwiseRanker(epochs=3).fit(Z.vectorised(training, ["x"], ["session", "aid", "gt"]))
    sinks.save_model(ranker.model, str(tmp_path / "m"))
    assert list(LogisticRegressionModel.load(str(tmp_path / "m")).coefficients) == list(ranker.model.coefficients)


def test_window_pairs_of_a_long_session(spark):
    rows = [(1, i % 7, i, "clicks") for i in range(120)] + [(2, 5, 0, "clicks")]
    got = {(r["aid"], r["aid_near"]): r["n"] for r in Z.window_pairs(spark.createDataFrame(rows, "session long, aid long, ts long, type string")).collect()}
    want = {}
    for i in range(120):
        for j in range(i + 1, min(120, i + 26)):
            want[i % 7, j % 7] = want.get((i % 7, j % 7), 0) + 1
    assert got == want


@pytest.mark.parametrize("shift", [0, 1 << 40])
def test_window_pairs_of_frequent_and_other_items(spark, shift):
    """An item with a third of the rows, one without an id, copies of an event and items too rare for a list of frequent ones."""
    rng = random.Random(5)
    rows = [(s, rng.choice([7, None, 100 + rng.randrange(5000)]), rng.randrange(50), "clicks") for s in range(40) for _ in range(60 + s)]
    rows = [(s, None if a is None else a - shift, ts, t) for s, a, ts, t in rows] + rows[:30]
    events = spark.createDataFrame(rows, "session long, aid long, ts long, type string")
    got = {(r["aid"], r["aid_near"]): r["n"] for r in Z.window_pairs(events, 9).collect()}
    placed, want = {}, {}
    for r in with_positions(events).select("session", "pos", "aid").collect():
        placed.setdefault(r["session"], {})[r["pos"]] = r["aid"]
    for own in placed.values():
        for p, a in own.items():
            for q in range(p + 1, p + 10):
                if q in own:
                    want[a, own[q]] = want.get((a, own[q]), 0) + 1
    assert got == want


def test_window_pairs_travel_as_lists(spark, monkeypatch):
    """Rows that meet in the last shuffle are those of the log, not its pairs, and go to as many parts as the pairs ask for."""
    monkeypatch.setattr(Z, "PART_PAIRS", 5000)
    rows = [(s, s * 50 + i, i, "clicks") for s in range(60) for i in range(50)]
    pairs = Z.window_pairs(spark.createDataFrame(rows, "session long, aid long, ts long, type string"))
    assert pairs.count() == 60 * sum(min(25, 49 - i) for i in range(50))
    assert pairs.rdd.getNumPartitions() >= 15


def test_pairs_that_matter_for_the_first_places_weigh_more(training):
    rows = Z.vectorised(training, ["x"], ["session", "aid", "gt"])
    ranker = Z.PairwiseRanker(ndcg=20).fit(rows)
    order = W.partitionBy("session").orderBy(F.desc("score"), "aid")
    placed = ranker.score(rows).withColumn("place", F.row_number().over(order)).drop("score")
    weights = [r["weight"] for r in Z.PairwiseRanker.pairs(placed, 20).select("weight").collect()]
    assert min(weights) >= 1e-3 and max(weights) <= 1.001 and len({round(w, 6) for w in weights}) > 5
    assert R.auc(ranker.score(rows)) > 0.9


def test_boosting_stops_at_its_best_round(training):
    rows = R.prepared(training, ["noise"])  # nothing to learn
    (model, _), *_ = R.fit_folds(rows, lambda: Z.BoostedRanker(rounds=20, depth=2), n=2)
    assert 1 <= model.best_round < 20


def test_folds_of_training_rows(training):
    assert folds(training).select("session", "fold").distinct().count() == 60


@pytest.mark.parametrize("name", ["rank_gbt_reg", "rank_gbt_clf"])
def test_registered_boosted_rankers_have_the_settings_of_the_class(spark, monkeypatch, name):
    from querybook import queries as Q

    monkeypatch.setattr(Q, "Testbed", lambda spark, sf_dir: None)
    monkeypatch.setattr(Q, "_held_out", lambda t, make: make())
    mine, whole = Q.QUERIES[name](spark, "").learner, Z.BoostedRanker().learner
    assert (mine.getMaxIter(), mine.getMaxDepth()) == (whole.getMaxIter(), whole.getMaxDepth()) == (50, 6)


def test_folds_share_their_pairs_and_large_ones_are_fitted_one_by_one(spark, monkeypatch):
    """Pairs of a fold's training rows are those of all rows without the fold; fits beyond FIT_ROWS don't overlap."""
    import threading

    from sessionlens.operators.models import PairwiseRanker
    from sessionlens.plans import ranking as R

    data = [(s, a, float(a == s % 4), s % 5, float((s * 7 + a * 3) % 11), float(a)) for s in range(20) for a in range(6)]
    rows = spark.createDataFrame(data, "session long, aid long, gt double, fold long, x double, y double")
    rows = R.vectorised(rows, ["x", "y"], [*R.KEYS, "gt", "fold"]).cache()
    flat = lambda df: sorted((r["label"], *r["features"], r["weight"]) for r in df.collect())
    shared = PairwiseRanker.shared(rows).cache()
    for fold in range(5):
        assert flat(shared.where(F.col("fold") != fold)) == flat(PairwiseRanker.pairs(rows.where(F.col("fold") != fold)))

    made, running, most, lock = [], [0], [0], threading.Lock()

    class Watched(PairwiseRanker):
        @classmethod
        def shared(cls, rows):
            made.append(1)
            return super().shared(rows)

        def fit(self, *args, **more):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            try:
                return super().fit(*args, **more)
            finally:
                with lock:
                    running[0] -= 1

    monkeypatch.setattr(R, "FIT_ROWS", 100)
    assert len(R.fit_folds(rows, lambda: Watched(epochs=2))) == 5
    assert len(made) == 1 and most[0] == 1


def test_weights_of_the_second_fit_are_made_for_all_folds_at_once(spark, monkeypatch):
    """Weights and pairs of a fold's second fit are those that its own placed rows give; duplicates of a row stay apart; pairs are made once."""
    rng = random.Random(3)
    data = [(s, a, float(a % 5 == s % 5), rng.gauss(a % 5 == s % 5, 1.0), rng.random()) for s in range(30) for a in range(12)]
    rows = R.prepared(spark.createDataFrame([*data, data[1]], "session long, aid long, gt double, x double, y double"), ["x", "y"])
    made, pairs = [], Z.PairwiseRanker.pairs
    monkeypatch.setattr(Z.PairwiseRanker, "pairs", staticmethod(lambda *args, **more: made.append(1) or pairs(*args, **more)))
    fitted = R.fit_folds(rows, lambda: Z.PairwiseRanker(epochs=4, ndcg=3))
    assert len(made) == 1 and len(fitted) == 5 and sum(scored.count() for _, scored in fitted) == 361

    shared = Z.PairwiseRanker.shared(rows).cache()
    first = [Z.PairwiseRanker(epochs=4, ndcg=3).fit_pairs(shared.where(F.col("fold") != f)) for f in range(5)]
    weighed = first[0].reweighed(shared, rows, first).cache()
    flat = lambda df: sorted((r["label"], *r["features"], round(r["weight"], 9)) for r in df.collect())
    for f in range(5):
        order = W.partitionBy("session").orderBy(F.desc("score"), F.asc("aid"))
        placed = first[f].score(rows.where(F.col("fold") != f)).withColumn("place", F.row_number().over(order)).drop("score")
        want = pairs(placed, 3)
        assert flat(weighed.where(F.col("fold") != f).withColumn("weight", F.col(f"weight{f}"))) == flat(want)
        whole = Z.PairwiseRanker(epochs=4, ndcg=3).fit(rows.where(F.col("fold") != f))
        assert [round(w, 6) for w in whole.weights()] == [round(w, 6) for w in fitted[f][0].weights()]
