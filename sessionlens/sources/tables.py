"""Readers. Each takes a path or glob, declares its schema and reads only the columns asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.functions import columns as C

INTERACTIONS = "session long, aid long, ts long, type string"
LABELS = "session long, type string, ground_truth array<long>"
CANDIDATES = "session long, aid long, rank long"
TYPED_CANDIDATES = "session long, aid long, type string, rank long"
SCORES = (
    "session long, aid long, score_mean double, score_std double, "
    "score_max double, score_min double, score_length long"
)


def _read(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str,
    columns: Sequence[str] | None,
    fmt: str,
    limit: int | None,
) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    paths = [path] if isinstance(path, str) else list(path)
    df = reader.format(fmt).load(paths)
    df = df.select(*columns) if columns else df
    return df if limit is None else df.limit(limit)


def read_interactions(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Event log in Parquet chunk files; several globs make one split. ``limit`` is for debugging."""
    return _read(spark, path, INTERACTIONS, columns, "parquet", limit)


def read_split(spark: SparkSession, root: str, cv: bool, test_only: bool = False, **kw) -> DataFrame:
    """Event log of the validation (``cv``) or the production split under ``root``."""
    split = "validation" if cv else "production"
    part = "test" if test_only else "*"
    return read_interactions(spark, f"{root}/{split}/{part}_parquet/*", **kw)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels in long form (session, type, aid) from nested lists."""
    return explode_labels(_read(spark, path, LABELS, None, "parquet", None))


def explode_labels(nested: DataFrame) -> DataFrame:
    """Nested labels to rows, from array<aid> or from struct<list array<struct<item>>>."""
    source = F.col("ground_truth")
    if nested.schema["ground_truth"].dataType.typeName() == "struct":
        source = F.col("ground_truth.list.item")
    return nested.select("session", "type", F.explode(source).alias("aid"))


def read_candidates(spark: SparkSession, path: str, typed: bool = False, fmt: str = "parquet") -> DataFrame:
    """Ranked candidates; rows of sessions without any (aid NULL) are left out."""
    schema = TYPED_CANDIDATES if typed else CANDIDATES
    return _read(spark, path, schema, None, fmt, None).filter(F.col("aid").isNotNull())


def explode_candidates(nested: DataFrame, column: str = "labels") -> DataFrame:
    """Lists of candidates to (session, aid, rank), rank = position from 1."""
    source = F.col(column)
    if nested.schema[column].dataType.typeName() == "struct":
        source = F.col(f"{column}.list.item")
    rows = nested.select("session", F.posexplode(source).alias("pos", "aid"))
    return rows.filter(F.col("aid").isNotNull()).select(
        "session", "aid", (F.col("pos") + 1).cast("long").alias("rank")
    )


def read_scores(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Distance scores, in one table or in chunks of sessions (``write_score_chunks``)."""
    return _read(spark, path, SCORES, [c.split()[0] for c in SCORES.split(", ")], "parquet", None)


def read_dataset(spark: SparkSession, path: str, type_: str | None = None) -> DataFrame:
    """Feature rows; ``type_`` prunes the partition directory of one objective."""
    df = spark.read.parquet(path)
    return df if type_ is None else df.filter(F.col("type") == type_).drop("type")


def describe(events: DataFrame, offset_hours: int) -> DataFrame:
    """Events with their derived columns: seconds, type code, UTC time and local date."""
    return events.select(
        "session",
        "aid",
        "ts",
        "type",
        C.seconds(F.col("ts")).alias("ts_s"),
        C.type_code(F.col("type")).alias("type_code"),
        C.event_time(F.col("ts")).alias("event_time"),
        C.local_day(F.col("ts"), offset_hours).alias("dt"),
    )
