from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sessionlens.config import DAY_MS, Settings
from sessionlens.operators import features as X
from sessionlens.plans.feature_table import Stats, candidate_features

from conftest import EVENT

T0 = 1_700_000_000_000


def test_single_event_session_has_recency_one(spark):
    one = spark.createDataFrame([(1, 2, T0, "carts")], EVENT)
    row = X.session_recency(one).first()
    assert row["log_recency_score"] == 1.0
    assert row["type_weighted_log_recency_score"] == 6.0


def test_recency_ends(spark):
    rows = spark.createDataFrame([(1, a, T0 + a, "clicks") for a in range(4)], EVENT)
    score = {r["aid"]: r["log_recency_score"] for r in X.session_recency(rows).collect()}
    assert math.isclose(score[3], 1.0)
    assert math.isclose(score[0], 2**0.1 - 1)


def test_day_eight_counts_in_totals_only(spark):
    rows = spark.createDataFrame([(1, 2, T0 + d * DAY_MS, "clicks") for d in range(8)], EVENT)
    row = Stats(rows).sessions.first()
    assert row["max_day_num"] == 8
    assert row["session_clicks_cnt"] == 8
    assert sum(row[f"session_clicks_cnt_day{d}"] for d in range(1, 8)) == 7


def test_local_day_is_shifted(spark):
    late = spark.createDataFrame([(1, 1, DAY_MS - 3_600_000, "clicks")], EVENT)  # 23:00 UTC
    assert str(X.day_numbers(late).first()["dt"]) == "1970-01-02"
    assert str(X.day_numbers(late, Settings(day_offset_hours=0)).first()["dt"]) == "1970-01-01"


def test_ratios_without_denominator(spark):
    rows = spark.createDataFrame([(1, 2, T0, "orders")], EVENT)
    stats = Stats(rows)
    row = stats.sessions.first()
    assert row["session_clicks_orders_ratio"] is None
    item = stats.items.first()
    assert item["avg_clicks_cnt"] == 0.0
    assert item["clicks_orders_ratio"] is None


def test_funnel_needs_a_positive_delay(spark):
    rows = [(1, 2, T0 + 5, "clicks"), (1, 2, T0, "carts"), (1, 3, T0, "clicks"), (1, 3, T0 + 7, "carts")]
    row = Stats(spark.createDataFrame(rows, EVENT)).sessions.first()
    assert row["min_sec_session_clicks_carts"] == row["max_sec_session_clicks_carts"] == 7
    assert row["avg_sec_session_carts_orders"] is None


def test_feature_table_shape(spark, events):
    none = spark.createDataFrame([], "session long, aid long, slot string, rank long")
    df = candidate_features(Stats(events), [none])
    assert len(df.columns) == 124 == len(set(df.columns))
    assert df.count() == df.select("session", "aid").distinct().count()
    assert df.filter(F.col("orders_rank").isNull()).count() == 0


def test_compact_keeps_values(events):
    stats = Stats(events)
    none = events.select("session", "aid", F.lit("transition").alias("slot"), F.lit(1).cast("long").alias("rank")).distinct()
    df = candidate_features(stats, [none])
    small = X.compact(df)
    assert dict(small.dtypes)["min_day_num"] == "smallint"
    wide = small.select(*[F.col(n).cast(t).alias(n) for n, t in df.dtypes])
    assert df.exceptAll(wide).count() == 0  # no value of any column is changed


def test_compact_refuses_what_does_not_fit(spark):
    big = spark.createDataFrame([(1, 2, 2**40)], "session long, aid long, clicks_rank long")
    with pytest.raises(Exception, match="clicks_rank does not fit"):
        X.compact(big).collect()


def test_folded_copies_equal_row_level_statistics(events):
    rows = X.session_recency(events)
    rows = rows.groupBy("session", "aid").agg(
        *[F.expr(f"{s}({m}) as {s}_{m}") for m in X.RECENCY for s in X.STATS], F.count("*").alias("n")
    )
    got = {(r["session"], r["aid"]): r for r in X.session_item_stats(events).collect()}
    for want in rows.collect():
        r = got[want["session"], want["aid"]]
        assert all(abs(r[c] - want[c]) < 1e-5 for c in want.asDict() if c[:4] in ("avg_", "min_", "max_"))
        assert want["n"] == r["session_aid_clicks_cnt"] + r["session_aid_carts_cnt"] + r["session_aid_orders_cnt"]


def test_one_event_logged_very_often(spark):
    copies = spark.range(200_000).select(
        F.lit(1).cast("long").alias("session"), F.lit(2).cast("long").alias("aid"), F.lit(T0).alias("ts"), F.lit("carts").alias("type")
    )
    row = X.session_item_stats(copies).first()
    assert row["session_aid_carts_cnt"] == 200_000
    assert row["avg_action_num_reverse_chrono"] == (200_000 - 1) / 2
    placed = X.session_recency(copies)
    assert placed.select("action_num_reverse_chrono").distinct().count() == 200_000
    mean = placed.agg(F.avg("log_recency_score")).first()[0]
    assert abs(row["avg_log_recency_score"] - mean) < 2e-6
