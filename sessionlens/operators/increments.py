"""Co-visitation kept up day by day.

A matrix is linear in what each session adds to it, and a session adds what its newest events hold. So two small tables
are kept, in a partition for each day: the tails of the sessions that had events on the day, and what the day changed in the pair
counts. A day reads the last tails of the sessions it touches, never the log, takes back what they had added
and adds what they hold now. Writing a day again replaces its own partitions only, so a day that failed is simply run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.config import TYPES, CovisitSpec
from sessionlens.operators.covisit import edge_counts, heaviest, pair_weights, session_tail
from sessionlens.sources.sinks import drop_staged, staged

COUNTS = ("n", "since_base", *TYPES)
_TAIL = "session long, aid long, ts long, type string, day int"


def add_day(path: str, day: int, events: DataFrame, spec: CovisitSpec) -> int:
    """Take the events (session, aid, ts, type) of a day into the state at ``path``; the number of tail rows that were read.

    Days are taken in order of time; a later run of the same day replaces it, if no day after it was taken yet.
    """
    spark = events.sparkSession
    new = staged(events.filter(F.col("type").isin(*spec.types)).select("session", "aid", "ts", "type"))
    old = staged(last_tails(spark, path, day).join(new.select("session").distinct(), "session", "left_semi"))
    now = staged(session_tail(old.unionByName(new), spec.tail).drop("n"))
    gone = edge_counts(old, spec).select("aid_x", "aid_y", *[(-F.col(c)).alias(c) for c in COUNTS])
    change = edge_counts(now, spec).unionByName(gone).groupBy("aid_x", "aid_y").agg(*[F.sum(c).alias(c) for c in COUNTS])
    changed = F.col(COUNTS[0]) != 0
    for c in COUNTS[1:]:
        changed |= F.col(c) != 0
    change = staged(change.where(changed))
    for name, table in (("tails", now), ("changes", change)):
        dated = table.withColumn("day", F.lit(day))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/{name}")
    read = old.count()
    drop_staged(new, old, now, change)
    return read


def last_tails(spark: SparkSession, path: str, before: int) -> DataFrame:
    """The tail of every session as of its last day before ``before``."""
    rows = _read(spark, f"{path}/tails", _TAIL).where(F.col("day") < before)
    last = rows.groupBy("session").agg(F.max("day").alias("day"))
    return rows.join(last, ["session", "day"], "left_semi").drop("day")


def counted(spark: SparkSession, path: str) -> DataFrame:
    """The pair counts of all days, as ``edge_counts`` of the whole log has them."""
    schema = "aid_x long, aid_y long, " + ", ".join(f"{c} long" for c in COUNTS) + ", day int"
    rows = _read(spark, f"{path}/changes", schema).groupBy("aid_x", "aid_y").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return rows.where("n > 0")


def covisit_kept(spark: SparkSession, path: str, spec: CovisitSpec, span: tuple[int, int], weighting: str | None = None) -> DataFrame:
    """Neighbours (aid_x, aid_y, wgt, n) from the state; ``span`` is the first and last second of the log.

    Counts serve all weightings of the same window, types and tail.
    """
    edges = counted(spark, path)
    return heaviest(pair_weights(edges, weighting or spec.weighting, edges, span), spec.top_n)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one before the first day."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
