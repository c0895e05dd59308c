from __future__ import annotations

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.functions.columns import stable_hash
from sessionlens.operators import ranking as K
from sessionlens.operators.timeline import with_positions


@pytest.fixture(scope="module")
def counts(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, 0 if rng.random() < 0.4 else rng.randint(0, 6), rng.randint(0, 3)) for i in range(300)]
    return spark.createDataFrame(rows, "aid long, day long, a long, b long")


def test_competition_ranks_equal_rank(counts):
    got = K.competition_ranks(counts, ["aid"], ["a", "b"], within=["day"])
    got = {(r["aid"], r["measure"]): r["rank"] for r in got.collect()}
    for m in ("a", "b"):
        w = W.partitionBy("day").orderBy(F.desc(m))
        for r in counts.select("aid", F.rank().over(w).alias("r")).collect():
            assert got[r["aid"], m] == r["r"]


@pytest.mark.parametrize("n", [0, 1, 57, 299, 300, 1000])
def test_smallest_is_an_exact_limit(counts, n):
    slot = F.col("a")  # few slots: the cut falls inside a big one
    got = sorted(r["aid"] for r in K.smallest(counts, slot, [F.asc("aid")], n).collect())
    want = sorted(r["aid"] for r in counts.orderBy("a", "aid").limit(n).collect())
    assert got == want


def test_smallest_with_an_aggregated_limit(counts):
    limit = F.lit(2) * F.count_if(F.col("b") == 0)
    rows = K.smallest(counts, F.col("a"), [F.asc("aid")], limit, counted=F.col("b") > 0).collect()
    zeros = counts.filter("b = 0").count()
    assert len(rows) == min(2 * zeros, counts.count() - zeros)
    assert all(r["b"] > 0 for r in rows)


def test_top_n_by_equals_plain_window(counts):
    order = [F.desc("a"), F.asc("aid")]
    got = K.top_n_by(counts, ["day"], order, F.col("day") * 7, F.col("aid"), rows=5)
    w = W.partitionBy("day").orderBy(*order)
    want = counts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= F.col("day") * 7)
    assert sorted(got.select("aid").collect()) == sorted(want.select("aid").collect())


def test_dense_index(spark):
    ids = spark.createDataFrame([(x,) for x in [5, 5, 70_000, 1, 900_000, 65_536]], "aid long")
    got = {r["aid"]: r["idx"] for r in K.dense_index(ids, "aid", start=1).collect()}
    assert got == {1: 1, 5: 2, 65_536: 3, 70_000: 4, 900_000: 5}


def test_stable_hash_does_not_overflow(spark):
    big = spark.range(1).select(F.lit(2**62).alias("x"))
    assert big.select(stable_hash("x" and F.col("x"), F.col("x"), F.col("x"))).first()[0] >= 0


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_positions_equal_a_whole_session_window(spark, events, parts):
    """Without merging of small ranges, so that sessions do lie in several."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        _positions_equal_a_window(events)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_a_session_inside_one_minute_is_split(spark):
    """A third of all rows in one session and one minute: no (session, range) group has more than its share."""
    hot = spark.range(20_000).select(F.lit(1).cast("long").alias("session"), F.col("id").alias("aid"), (F.col("id") % 60_000).alias("ts"), F.lit("clicks").alias("type"))
    rest = spark.range(40_000).select((2 + F.col("id") % 2000).alias("session"), (F.col("id") % 50).alias("aid"), F.col("id").alias("ts"), F.lit("carts").alias("type"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        rows = hot.union(rest).withColumn("n", F.lit(1))
        ranges = rows.repartitionByRange("session", "ts", "aid", "type").groupBy("session", F.spark_partition_id()).count()
        assert ranges.agg(F.max("count")).first()[0] < 5000
        placed = with_positions(hot.union(rest)).filter("session = 1")
        assert placed.filter(F.col("pos") != F.col("aid")).count() == 0 and placed.count() == 20_000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def _positions_equal_a_window(events):
    got = with_positions(events)
    w = W.partitionBy("session").orderBy("ts", "aid", "type")
    whole = W.partitionBy("session")
    want = events.select(
        "session",
        "aid",
        "ts",
        "type",
        (F.row_number().over(w) - 1).alias("pos"),
        F.count("*").over(whole).alias("length"),
        F.min("ts").over(whole).alias("start_ts"),
        F.max("ts").over(whole).alias("end_ts"),
        F.lead("aid").over(w).alias("next_aid"),
    ).withColumn("pos_from_end", F.col("length") - F.col("pos") - 1)
    cols = sorted(want.columns)
    key = repr
    assert sorted(got.select(cols).collect(), key=key) == sorted(want.select(cols).collect(), key=key)


def test_rows_are_dealt_by_their_number_not_their_bytes(spark, monkeypatch):
    """A partition that adaptive execution would merge stays as it was dealt; a key stays in one of them."""
    monkeypatch.setattr(K, "DEALT_ROWS", 100)
    rows = spark.range(1000).select((F.col("id") % 200).alias("session"), "id")
    placed = K.dealt(rows, "session").withColumn("part", F.spark_partition_id())
    assert placed.rdd.getNumPartitions() == 10
    assert placed.count() == 1000 and placed.select("session", "part").distinct().count() == 200
    assert K.dealt(rows.limit(0), "session").count() == 0


def test_rows_of_a_varying_bound_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(K, "RANKED_ROWS", 100)
    rows = [(s, a, s % 4) for s in range(50) for a in range(20)] + [(99, a, 30) for a in range(500)]
    df = spark.createDataFrame(rows, "session long, aid long, quota long")
    best = K.top_n_by(df, ["session"], [F.asc("aid")], F.col("quota"), F.col("aid"), rows=50)
    assert best.rdd.getNumPartitions() >= 15
    want = sorted([(s, a) for s in range(50) for a in range(s % 4)] + [(99, a) for a in range(30)])
    assert sorted((r["session"], r["aid"]) for r in best.collect()) == want
