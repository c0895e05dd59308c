"""Threshold reading of posting lists against reading all of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sessionlens.functions.columns import round6
from sessionlens.operators import candidates as G
from sessionlens.operators.postings import best_sums, posting_lists
from sessionlens.operators.ranking import top_n


def plain(tails, model, k):
    scored = tails.join(model, "aid").groupBy("session", "aid_next").agg(round6(F.sum(F.col("p") / F.col("back"))).alias("score"))
    return rows(top_n(scored, ["session"], [F.desc("score"), F.asc("aid_next")], k))


def rows(df):
    return sorted((r["session"], r["rank"], r["aid_next"], r["score"]) for r in df.collect())


def model_of(spark, lists):
    totals = {a: sum(c for _, c in own) for a, own in lists.items()}
    data = [(a, b, n / totals[a]) for a, own in lists.items() for b, n in own]
    return spark.createDataFrame(data, "aid long, aid_next long, p double")


@pytest.mark.parametrize("seed, first, k", [(1, 2, 5), (2, 8, 10), (3, 3, 40)])
def test_equal_to_reading_everything(spark, seed, first, k):
    rng = random.Random(seed)
    lists = {a: [(b, rng.choice([1, 1, 2, 9, 60])) for b in rng.sample(range(80), rng.choice([1, 5, 30, 70]))] for a in range(25)}
    tails = [(s, a, i + 1) for s in range(30) for i, a in enumerate(rng.sample(range(27), rng.randint(1, 20)))]
    model = model_of(spark, lists)
    tails = spark.createDataFrame(tails, "session long, aid long, back long")
    assert rows(best_sums(tails, posting_lists(model), k, first)) == plain(tails, model, k)


def test_a_long_list_is_read_as_far_as_it_matters(spark):
    """One item with 100,000 successors of falling weight, and a session for which only the item's list counts."""
    lists = {1: [(b, 1 + 4_000_000 // (b + 1)) for b in range(100_000)], 2: [(7, 5), (9, 1)], 3: [(b, 1) for b in range(300)]}
    model = model_of(spark, lists)
    tails = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (2, 1, 2), (3, 3, 1), (3, 1, 4), (4, 1, 9), (5, 99, 1)], "session long, aid long, back long")
    log = []
    assert rows(best_sums(tails, posting_lists(model), 100, 256, log)) == plain(tails, model, 100)
    assert log[-1][1] <= 4096  # of 100,000 places


def test_sequence_candidates_do_not_depend_on_the_first_read(spark, events):
    model = G.transitions(events)
    want = sorted(map(tuple, G.sequence_candidates(events, model, k=6).collect()))
    assert sorted(map(tuple, G.sequence_candidates(events, model, k=6, first=2).collect())) == want


def test_empty_tables(spark, events):
    model = G.transitions(events.limit(0))
    assert G.sequence_candidates(events, model).count() == 0
    assert best_sums(G.sequence_tail(events.limit(0)), posting_lists(model), 5).count() == 0
