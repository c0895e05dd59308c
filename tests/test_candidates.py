"""Pair building and voting against a plain Python restatement."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sessionlens.config import COVISIT, COVISIT_TYPE_WEIGHT
from sessionlens.operators import candidates as G
from sessionlens.operators import ranking as K
from sessionlens.operators.covisit import covisit, item_pairs
from sessionlens.sources.sinks import staged
from sessionlens.sources.tables import explode_candidates

from conftest import EVENT


def by_session(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[1], r[3])):
        out[r[0]].append(r)
    return out


def brute_covisit(rows, spec, span=None):
    weights = Counter()
    for history in by_session([r for r in rows if r[3] in spec.types]).values():
        tail = history[-spec.tail :]
        best = {}
        for x in tail:
            for y in tail:
                if x[1] != y[1] and abs(x[2] // 1000 - y[2] // 1000) < spec.window_ms // 1000:
                    kind = None if spec.weighting == "recency" else y[3]
                    key = (x[1], y[1], kind)
                    best[key] = max(best.get(key, 0), x[2] // 1000)
        for (a, b, kind), ts in best.items():
            if spec.weighting == "recency":
                weights[a, b] += 1 + 3 * (ts - span[0]) / (span[1] - span[0])
            else:
                weights[a, b] += COVISIT_TYPE_WEIGHT[kind] if spec.weighting == "type" else 1
    near = defaultdict(list)
    for (a, b), w in weights.items():
        near[a].append((-round(w, 6), b))
    return {a: [b for _, b in sorted(ws)[: spec.top_n]] for a, ws in near.items()}


def neighbour_lists(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["n"]):
        out[r["aid_x"]].append(r["aid_y"])
    return dict(out)


@pytest.mark.parametrize("mode", sorted(COVISIT))
def test_covisit(events, event_rows, mode):
    seconds = [r[2] // 1000 for r in event_rows]
    span = (min(seconds), max(seconds))
    assert neighbour_lists(covisit(events, mode)) == brute_covisit(event_rows, COVISIT[mode], span)


def test_pairs_are_symmetric(events):
    pairs = item_pairs(events, COVISIT["clicks"])
    one = pairs.groupBy("aid_x", "aid_y").count()
    two = pairs.groupBy(F.col("aid_y").alias("aid_x"), F.col("aid_x").alias("aid_y")).count()
    assert one.exceptAll(two).count() == 0


def test_row_order_and_partitions_change_nothing(spark, events):
    want = sorted(covisit(events, "clicks").collect())
    assert sorted(covisit(events.orderBy(F.rand(5)).repartition(7), "clicks").collect()) == want


def unique_newest(history):
    return list(dict.fromkeys(r[1] for r in reversed(history)))


def test_suggest_clicks_and_buys(events, event_rows):
    clicks, buys, b2b = (covisit(events, m) for m in ("clicks", "carts_orders", "buy2buy"))
    nc, nb, n2 = map(neighbour_lists, (clicks, buys, b2b))
    got_c = neighbour_lists(G.suggest_clicks(events, clicks, 12).withColumnsRenamed({"session": "aid_x", "aid": "aid_y", "rank": "n"}))
    got_b = neighbour_lists(G.suggest_buys(events, buys, b2b, 12).withColumnsRenamed({"session": "aid_x", "aid": "aid_y", "rank": "n"}))
    for session, history in by_session(event_rows).items():
        seen = unique_newest(history)
        bought = unique_newest([r for r in history if r[3] != "clicks"])
        votes = [y for a in seen for y in nc.get(a, [])]
        assert got_c[session] == [a for a, _ in Counter(votes).most_common(12)]
        votes = [y for a in seen for y in nb.get(a, [])] + [y for a in bought for y in n2.get(a, [])]
        assert got_b[session] == [a for a, _ in Counter(votes).most_common(12)]


def test_recent_unique_items(events, event_rows):
    rows = G.recent_unique_items(events).collect()
    for session, history in by_session(event_rows).items():
        mine = [r["aid"] for r in sorted(rows, key=lambda r: r["position"]) if r["session"] == session]
        assert mine == unique_newest(history)


def test_session_without_neighbours_gives_no_rows(spark, events):
    alone = spark.createDataFrame([(99, 1234, 1, "clicks")], EVENT)
    assert G.suggest_clicks(alone, covisit(events, "clicks")).count() == 0


def test_popular_candidates_are_all_sessions_times_all_items(spark, events):
    popular = spark.createDataFrame([(a,) for a in (5, 6, 7)], "aid long")
    got = G.popular_candidates(events, popular)
    sessions = events.select("session").distinct().count()
    assert got.count() == got.distinct().count() == 3 * sessions


def test_list_positions_become_ranks(spark):
    nested = spark.createDataFrame([(1, [9, 8, 7]), (2, []), (3, None)], "session long, labels array<long>")
    got = sorted(map(tuple, explode_candidates(nested).collect()))
    assert got == [(1, 7, 3), (1, 8, 2), (1, 9, 1)]
    deep = spark.createDataFrame(
        [(1, ([(4,), (5,)],))], "session long, labels struct<list:array<struct<item:long>>>"
    )
    assert sorted(map(tuple, explode_candidates(deep).collect())) == [(1, 4, 1), (1, 5, 2)]


def test_transitions_sum_to_one(events):
    p = G.transitions(events).groupBy("aid").agg(F.sum("p").alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-9 for r in p)


def test_rank_cut(spark):
    rows = spark.createDataFrame([(1, a, a) for a in range(1, 6)], "session long, aid long, rank long")
    assert G.tall_source(rows, "transition", max_rank=3).count() == 3


def test_move_counts_equal_the_pairs(events):
    pairs = G.next_item_pairs(events).groupBy("aid", "aid_next").count()
    assert sorted(map(tuple, G.move_counts(events).collect())) == sorted(map(tuple, pairs.collect()))


def test_pairs_and_votes_are_made_in_parts_of_bounded_size(spark, monkeypatch):
    """What is made of many rows does not land in the few partitions that its small input would fill."""
    rows = [(s, a, 1_700_000_000_000 + a, "clicks") for s in range(300) for a in range(8)]
    log = spark.createDataFrame(rows, EVENT)
    near = spark.createDataFrame([(a, (a + j) % 8, float(j), j) for a in range(8) for j in range(1, 6)], "aid_x long, aid_y long, wgt double, n int")
    monkeypatch.setattr(K, "DEALT_ROWS", 100)
    assert item_pairs(log, COVISIT["clicks"]).rdd.getNumPartitions() == 24
    assert G.suggest_clicks(log, near).rdd.getNumPartitions() == 24
    assert G.suggest_buys(log, near, near).rdd.getNumPartitions() == 24
    assert G.sequence_candidates(log, staged(G.transitions(log))).rdd.getNumPartitions() == 24


def test_successors_are_added_up_in_parts_whatever_the_join(spark, monkeypatch):
    """A model that does not go to all executors meets the tails by item; its sums are still made where the session is."""
    rows = [(s, a * (s % 3 + 1) % 8, 1_700_000_000_000 + a, "clicks") for s in range(300) for a in range(8)]
    log = spark.createDataFrame(rows, EVENT)
    model = staged(G.transitions(log))
    want = sorted(map(tuple, G.sequence_candidates(log, model, k=3).collect()))
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    try:
        monkeypatch.setattr(K, "DEALT_ROWS", 100)
        parts = G.sequence_tail(log).count() // 100
        for small in (G.SMALL_MODEL, 1):
            monkeypatch.setattr(G, "SMALL_MODEL", small)
            got = G.sequence_candidates(log, model, k=3)
            assert sorted(map(tuple, got.collect())) == want
            assert got.rdd.getNumPartitions() == parts
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)


def test_long_histories_vote_alike(spark, events, monkeypatch):
    near, bought = covisit(events, "carts_orders"), covisit(events, "buy2buy")
    lists = lambda: (G.suggest_clicks(events, near), G.suggest_buys(events, near, bought))
    whole = [sorted(map(tuple, x.collect())) for x in lists()]
    monkeypatch.setattr(G, "LONG", 14)
    assert events.groupBy("session").agg(F.count_distinct("aid").alias("n")).agg((F.max("n") > 14) & (F.min("n") <= 14)).first()[0]
    assert [sorted(map(tuple, x.collect())) for x in lists()] == whole
