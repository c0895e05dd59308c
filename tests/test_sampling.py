from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import candidates as G
from sessionlens.functions.columns import stable_hash
from sessionlens.operators import sampling as S
from sessionlens.operators.ranking import top_n


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [(s, a) for s in range(1, 6) for a in range(200 if s == 1 else 30)]
    return spark.createDataFrame(rows, "session long, aid long")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, "clicks", 4), (1, "carts", 4), (1, "clicks", 5), (2, "carts", 3), (3, "orders", 999), (4, "orders", 1)]
    return spark.createDataFrame(rows, "session long, type string, aid long")


def test_item_with_two_label_types_stays_one_row(candidates, labels):
    assert S.join_labels(candidates, labels).filter("session = 1 and aid = 4").count() == 2
    keys = S.training_keys(candidates, labels, "clicks")
    assert keys.filter("session = 1 and aid = 4").count() == 1


def test_negatives_respect_the_quota_and_avoid_labels(candidates, labels):
    joined = S.join_labels(candidates, labels)
    targets = S.target_sessions(joined, "clicks")
    assert [r["session"] for r in targets.collect()] == [1]
    rows = S.negative_list(joined, targets, "clicks", per_positive=20).collect()
    assert len(rows) == 2 * 20
    assert not {r["aid"] for r in rows} & {4, 5}


def test_session_with_an_unreachable_label_is_no_target(candidates, labels):
    joined = S.join_labels(candidates, labels)
    assert [r["session"] for r in S.target_sessions(joined, "orders").collect()] == [4]


def test_global_sample_size(candidates, labels):
    labeled = S.labeled_candidates(candidates, labels, "clicks")
    sizes = {r["gt"]: r["size"] for r in S.class_balance(S.global_negative_sample(labeled, 30)).collect()}
    assert sizes == {0: 60, 1: 2}


def test_folds_keep_sessions_together(events):
    rows = S.folds(events, 5).select("session", "fold").distinct()
    assert rows.count() == events.select("session").distinct().count()


def test_session_sample(events):
    got = S.session_sample(events, 4, seed=3)
    sessions = [r["session"] for r in got.select("session").distinct().collect()]
    assert len(sessions) == 4
    assert got.count() == events.filter(F.col("session").isin(sessions)).count()


def test_ratio_split(spark):
    rows = [(s, a, a, "clicks") for s, n in ((1, 1), (2, 2), (3, 9), (4, 25)) for a in range(n)]
    events = spark.createDataFrame(rows, "session long, aid long, ts long, type string")
    held = Counter(r["session"] for r in S.ratio_split(events).filter("part = 1").collect())
    assert held == {2: 1, 3: 1, 4: 2}
    newest = S.ratio_split(events).filter("part = 1 and session = 4").agg(F.min("ts")).first()[0]
    assert newest == 23


def test_kcore(events, event_rows):
    rows = list(event_rows)
    while True:
        sessions, items = Counter(r[0] for r in rows), Counter(r[1] for r in rows)
        kept = [r for r in rows if sessions[r[0]] >= 30 and items[r[1]] >= 25]
        if len(kept) == len(rows):
            break
        rows = kept
    got = [tuple(r) for r in S.kcore(events, 30, 25).select("session", "aid", "ts", "type").collect()]
    assert sorted(got) == sorted(rows)


def test_pair_negatives_permute_the_successors(events):
    pairs = G.next_item_pairs(events)
    got = S.pair_negatives(pairs, batch_size=100)
    assert got.count() == pairs.count()
    right = Counter(r["aid_next"] for r in got.collect())
    wrong = Counter(r["aid_wrong"] for r in got.collect())
    assert right == wrong


def test_pair_holdout_is_exact(events):
    assert S.pair_holdout(events, 50).filter("valid = 1").count() == 50


def test_draws_are_as_independent_as_chance(spark):
    """Pairs of items are drawn together about as often as chance says, and seeds have nothing in common."""
    rows = spark.range(200).crossJoin(spark.range(50).withColumnRenamed("id", "aid")).withColumnRenamed("id", "session")
    order = [stable_hash(F.col("session"), F.col("aid"))]
    drawn = top_n(rows, ["session"], order, 10).select("session", "aid")
    sets = {}
    for r in drawn.collect():
        sets.setdefault(r["session"], set()).add(r["aid"])
    pairs = [sum({a, b} <= s for s in sets.values()) for a in range(50) for b in range(a)]
    assert max(pairs) <= 25 and sum(p == 0 for p in pairs) <= 12  # expected: 7.3 each
    keys = spark.range(2000).withColumnRenamed("id", "session")
    one, two = ({r[0] for r in S.sample_keys(keys, "session", 1000, seed=s).collect()} for s in (0, 42))
    assert len(one) == len(two) == 1000 and 430 <= len(one & two) <= 570


def test_folds_hold_about_as_many_rows(spark):
    rows = spark.createDataFrame([(s, i) for s in range(100) for i in range(1 + s % 7 * 5)], "session long, aid long")
    sizes = [r["count"] for r in S.folds(rows, 5).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 40


def test_shuffled_rows(spark):
    rows = spark.range(100).withColumnRenamed("id", "session")
    one = [r["session"] for r in S.shuffled_rows(rows, "session", seed=1).orderBy("place").collect()]
    two = [r["session"] for r in S.shuffled_rows(rows, "session", seed=2).orderBy("place").collect()]
    assert sorted(one) == sorted(two) == list(range(100)) and one != two


def test_kcore_needs_several_passes(spark):
    """A chain that falls apart from its end: each pass takes one more link."""
    rows = [(s, s + d) for s in range(6) for d in (0, 1)] + [(100, 0), (101, 0)]
    events = spark.createDataFrame([(s, a, 0, "clicks") for s, a in rows], "session long, aid long, ts long, type string")
    left, passes = events, 0
    while True:
        after = S.kcore_round(left, 2, 2).collect()
        if len(after) == left.count():
            break
        left, passes = spark.createDataFrame(after, events.schema), passes + 1
    assert passes >= 3
    assert sorted(S.kcore(events, 2, 2).collect()) == sorted(left.collect())


def test_peeling_touches_what_it_removes(spark):
    """A chain that falls apart from its end: every pass takes two pairs, whatever else is in the log."""
    chain = [(s, a, 0, "clicks") for s in range(10) for a in (s, s + 1)]
    core = [(s, a, 0, "clicks") for s in range(100, 150) for a in range(1000, 1040)]
    events = spark.createDataFrame(chain + core, "session long, aid long, ts long, type string")
    log = []
    kept = S.kcore(events, 2, 2, log)
    assert sorted((r["session"], r["aid"]) for r in kept.collect()) == sorted((s, a) for s, a, *_ in core)
    assert sum(log) <= 2 * len(chain) and max(log) <= 4 and kept.columns == events.columns
    assert S.kcore(events.limit(0), 2, 2).count() == 0
