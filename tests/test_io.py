from __future__ import annotations

import glob

from pyspark.sql import functions as F

from sessionlens.functions import lists as L
from sessionlens.operators.submission import submission
from sessionlens.sources import sinks, tables


def test_interactions_round_trip(spark, events, tmp_path):
    root = str(tmp_path)
    sinks.write_parquet(events, f"{root}/validation/test_parquet")
    sinks.write_parquet(events.limit(10), f"{root}/validation/train_parquet")
    assert tables.read_split(spark, root, cv=True).count() == events.count() + 10
    test = tables.read_split(spark, root, cv=True, test_only=True, columns=["session", "aid"])
    assert test.columns == ["session", "aid"] and test.count() == events.count()
    scan = test._jdf.queryExecution().executedPlan().toString()
    assert "ts#" not in scan
    assert tables.read_split(spark, root, cv=True, limit=5).count() == 5


def test_candidates_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "carts", 1), (1, None, "carts", 2)], tables.TYPED_CANDIDATES.replace("aid long, type string", "aid long, type string"))
    path = str(tmp_path / "c")
    sinks.write_candidates_csv(rows, path)
    back = tables.read_candidates(spark, path, typed=True, fmt="csv")
    assert [tuple(r) for r in back.select("session", "aid", "type", "rank").collect()] == [(1, 2, "carts", 1)]


def test_labels_of_both_nestings(spark, tmp_path):
    flat = spark.createDataFrame([(1, "carts", [4, 5])], tables.LABELS)
    sinks.write_parquet(flat, str(tmp_path / "l"))
    assert tables.read_labels(spark, str(tmp_path / "l")).count() == 2
    deep = flat.select("session", "type", F.expr("struct(transform(ground_truth, x -> struct(x as item)) as list)").alias("ground_truth"))
    assert sorted(map(tuple, tables.explode_labels(deep).collect())) == [(1, "carts", 4), (1, "carts", 5)]


def test_sequence_file_headers(spark, events, tmp_path):
    sinks.write_sequence_tsv(events, str(tmp_path / "s"))
    files = glob.glob(str(tmp_path / "s" / "part-*"))
    assert open(files[0]).readline().rstrip("\n") == "session:token\taid:token\tts:float"
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "s"))
    assert back.count() == events.count()


def test_typed_dataset_is_partitioned(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "carts"), (3, 4, "clicks")], "session long, aid long, type string")
    sinks.write_parquet(rows, str(tmp_path / "d"), partition_by="type")
    got = tables.read_dataset(spark, str(tmp_path / "d"), "carts")
    assert [tuple(r) for r in got.collect()] == [(1, 2)]


def test_scores_and_submission_files(spark, tmp_path):
    scores = spark.createDataFrame([(s, a, "carts", 1.0 / (1 + a)) for s in range(9) for a in range(3)], "session long, aid long, type string, score double")
    sinks.write_score_chunks(scores, str(tmp_path / "p"), chunks=4)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 27
    assert back.groupBy("session").agg(F.countDistinct("chunk").alias("n")).filter("n > 1").count() == 0
    sinks.write_submission_csv(submission(scores), str(tmp_path / "sub"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sub")).columns == ["session_type", "labels"]


def test_staged_and_checkpointed_rows(events):
    assert sinks.staged(events).exceptAll(events).count() == 0
    assert sinks.checkpointed(events).exceptAll(events).count() == 0


def test_list_helpers(spark):
    df = spark.createDataFrame([([1, 2, 1, 3],)], "a array<long>")
    row = df.select(
        L.newest_first_unique(F.col("a")).alias("u"),
        L.pad_right(F.col("a"), 6).alias("p"),
        L.last_k(F.col("a"), 2).alias("l"),
        L.last_k(F.col("a"), 9).alias("all"),
        L.first_k(F.col("a"), 2).alias("f"),
        L.overlap(F.col("a"), F.array(F.lit(3).cast("long"), F.lit(9).cast("long"))).alias("o"),
    ).first()
    assert (row["u"], row["p"], row["l"], row["all"], row["f"], row["o"]) == (
        [3, 1, 2], [1, 2, 1, 3, 0, 0], [1, 3], [1, 2, 1, 3], [1, 2], 1
    )
