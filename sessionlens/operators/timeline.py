"""Positions of events inside sessions of any length.

The canonical order of a session is (ts, aid, type); "most recent first" is its exact reverse.
A window over a whole session would put a bot's session in one task. Here all rows are dealt in ranges of
(session, ts, aid, type), as many as the data ask for, and rows are ordered inside (session, range)
groups; a summary with one row per group carries counts, bounds and the next item across ranges. However
many events a session has, and however close together, no group is larger than a range.

Copies of an event are folded into one row with a count before anything is ordered, so that an event
logged over and over stays one row in its group. ``event_runs`` keeps them folded, which is enough for
sums and counts; ``with_positions`` gives each its own row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.sources.sinks import staged

RUN_BLOCK = 1 << 16


def _placed(rows: DataFrame, key: str, at: str, ties: Sequence[str]) -> DataFrame:
    """Adds pos, length, start_ts, end_ts and next_aid to rows that stand for ``n`` events each.

    The ranges are staged, as they are drawn from a sample. The first row of each (key, range) carries the
    summary of the group; both uses of the ordered rows read one shuffle.
    """
    rows = staged(rows.repartitionByRange(key, at, *ties).withColumn("_slice", F.spark_partition_id()))
    slice_ = W.partitionBy(key, "_slice")
    inside = slice_.orderBy(at, *ties)
    ahead = F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, -1))
    rows = (
        rows.withColumn("_ahead", F.coalesce(ahead, F.lit(0)))
        .withColumn("_lead", F.lead("aid").over(inside))
    )

    earlier = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    ordered = W.partitionBy(key).orderBy("_slice")
    whole = W.partitionBy(key)
    summed = rows.withColumn("_n", F.sum("n").over(slice_)).withColumn("_hi", F.max(at).over(slice_))
    slices = summed.filter(F.col("_ahead") == 0).select(
        key,
        "_slice",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.lead("aid").over(ordered).alias("_next_first"),
        F.sum("_n").over(whole).alias("length"),
        F.min(at).over(whole).alias("start_ts"),
        F.max("_hi").over(whole).alias("end_ts"),
    )
    return (
        rows.join(slices, [key, "_slice"])
        .withColumn("pos", F.col("_before") + F.col("_ahead"))
        .withColumn("next_aid", F.coalesce("_lead", "_next_first"))
        .drop("_slice", "_ahead", "_lead", "_before", "_next_first")
    )


def event_runs(events: DataFrame) -> DataFrame:
    """Distinct events with their number ``n``, the place ``pos`` of the first copy (0 = oldest event),
    the session's length, start_ts and end_ts, and the item after the last copy (next_aid)."""
    runs = events.groupBy("session", "aid", "ts", "type").agg(F.count(F.lit(1)).alias("n"))
    return _placed(runs, "session", "ts", ["aid", "type"])


def with_positions(events: DataFrame) -> DataFrame:
    """Every event with pos (0 = oldest), pos_from_end (0 = newest), length, start_ts, end_ts, next_aid.

    Copies are unfolded in two steps, so that no array grows with their number.
    """
    block = F.lit(RUN_BLOCK)
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))
    last = F.least(F.col("n"), (F.col("_b") + 1) * block) - 1
    rows = event_runs(events).withColumn("_b", F.explode(blocks))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.col("_b") * block, last)))
    follower = F.when(F.col("_i") < F.col("n") - 1, F.col("aid")).otherwise(F.col("next_aid"))
    return (
        rows.withColumn("pos", F.col("pos") + F.col("_i"))
        .withColumn("pos_from_end", F.col("length") - F.col("pos") - 1)
        .withColumn("next_aid", follower)
        .drop("n", "_b", "_i")
    )


def numbered(rows: DataFrame, at: str, key: str = "session") -> DataFrame:
    """Rows that are unique in (key, at, aid), numbered from both ends by (at, aid)."""
    placed = _placed(rows.withColumn("n", F.lit(1)), key, at, ["aid"] if at != "aid" else [])
    return placed.withColumn("pos_from_end", F.col("length") - F.col("pos") - 1).drop(
        "n", "start_ts", "end_ts", "next_aid"
    )
