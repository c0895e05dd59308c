"""Ranks, top-n and exact limits that hold up when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.functions.columns import HASH_BITS, count_when
from sessionlens.sources.sinks import staged


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows of each group, ranks from 1.

    A constant bound on row_number lets Spark cut every group to ``n`` rows in each map task
    (WindowGroupLimit) before the shuffle, so a hot group sends at most ``n`` rows per task.
    """
    numbered = df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(out) <= n).withColumn(out, F.col(out).cast("long"))


def top_n_by(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bound: Column,
    spread: Column,
    rows: int = 4096,
) -> DataFrame:
    """First ``bound`` rows of each group, where the bound is a column.

    Spark has no group limit for a bound that varies, so a group is first cut in parts of about
    ``rows`` rows side by side, as many as its size asks for; of each part at most ``bound`` rows are
    left for the group as a whole. Exact, as both cuts use one total order. Parts and groups are dealt by
    the number of rows, as adaptive execution would put as many small rows in a task as 64 MB hold.
    """
    sizes = staged(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ways")))
    total = sizes.agg(F.sum("_ways")).first()[0] or 0
    part = W.partitionBy(*keys, "_part").orderBy(*order)
    whole = W.partitionBy(*keys).orderBy(*order)
    parted = df.join(sizes.withColumn("_ways", F.ceil(F.col("_ways") / rows)), list(keys))
    parted = parted.withColumn("_part", F.pmod(F.xxhash64(spread), F.col("_ways")))
    first = dealt(parted, *keys, "_part", count=total, size=RANKED_ROWS)
    first = first.withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= bound)
    return (
        dealt(first, *keys, count=total, size=RANKED_ROWS)
        .withColumn("_rn", F.row_number().over(whole))
        .filter(F.col("_rn") <= bound)
        .drop("_part", "_rn", "_ways")
    )


DEALT_ROWS = 50_000
RANKED_ROWS = 500_000  # where a task only orders its rows


def dealt(rows: DataFrame, *keys: str, count: int | None = None, size: int | None = None) -> DataFrame:
    """Rows dealt by ``keys`` in parts of about ``size`` rows (DEALT_ROWS), of which there are ``count`` (else they are staged and counted).

    For a step that makes many rows of each: adaptive execution merges partitions by the bytes that go in, which says
    nothing about what a task then has to hold. It leaves a given number of partitions alone. No key may have
    more rows than a part should.
    """
    if count is None:
        rows = staged(rows)
        count = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, -(-count // (size or DEALT_ROWS)), min(cores, count // 1000)), *keys)


HOT_KEYS = 1000
LANES = 64


def salted_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str, spread: Column) -> DataFrame:
    """Inner join of ``rows`` with a table of one row for each value of ``keys``, which says how many rows have it.

    A value of 1/HOT_KEYS of all rows or more, of which there are HOT_KEYS at most, is dealt over LANES keys by
    ``spread``, and its row of the table is repeated for each. ``table`` should be staged: it is read three times.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) * HOT_KEYS >= total
    hot = F.broadcast(table.where(often).select(*keys, F.lit(LANES).alias("_lanes")))  # HOT_KEYS rows at most
    dealt = rows.join(hot, list(keys), "left").withColumn("_lane", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_lanes")), F.lit(0)))
    lanes = F.explode(F.sequence(F.lit(0).cast("long"), F.when(often, F.lit(LANES - 1)).otherwise(0).cast("long")))
    return dealt.drop("_lanes").join(table.withColumn("_lane", lanes).drop(count), [*keys, "_lane"]).drop("_lane")


def competition_ranks(
    df: DataFrame, ids: Sequence[str], measures: Sequence[str], within: Sequence[str] = ()
) -> DataFrame:
    """RANK() ... ORDER BY measure DESC for many measures, in long form (ids, within, measure, rank).

    The rank of a value is one plus the number of rows with a greater value, so only the histogram
    of each measure is ordered, not the rows. Distinct counts among N events number at most
    sqrt(2 N), which bounds each ordered group; rows never meet in one task.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures])
    tall = df.select(*ids, *within, F.inline(pairs))
    keys = [*within, "measure"]
    above = W.partitionBy(*keys).orderBy(F.desc("value")).rowsBetween(W.unboundedPreceding, -1)
    ranks = (
        tall.groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, "value", "n", (F.lit(1) + F.coalesce(F.sum("n").over(above), F.lit(0))).alias("rank"))
    )
    spread = F.struct(*[F.col(c) for c in ids])
    return salted_join(tall, staged(ranks), [*keys, "value"], "n", spread).select(*ids, *keys, "rank")


SLOT_BITS = 20


def smallest(
    df: DataFrame, hashed: Column, order: Sequence[Column], limit: int | Column, counted: Column | None = None
) -> DataFrame:
    """Exactly the first ``limit`` rows by (hashed, order), without one task sorting them all.

    ``hashed`` is a number of HASH_BITS bits, spread evenly; ``limit`` a number or an aggregate over the
    table (e.g. ``80 * count_if(positive)``); ``counted`` marks the rows that take part (others are dropped).
    The first SLOT_BITS bits make a histogram, of a million rows at most. Whole slots below the cut pass
    without a sort; only rows of the slot the cut falls in, a millionth of all, are numbered.
    """
    counted = F.lit(True) if counted is None else counted
    fixed = isinstance(limit, int)
    slotted = df.withColumn("_hash", hashed).withColumn("_slot", F.shiftright("_hash", HASH_BITS - SLOT_BITS))
    ahead = W.partitionBy().orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    total = F.lit(limit) if fixed else F.sum("_limit").over(W.partitionBy())
    room = (
        slotted.groupBy("_slot")
        .agg(count_when(counted).alias("_n"), (F.lit(0) if fixed else limit).alias("_limit"))
        .withColumn("_limit", total)
        .withColumn("_room", F.col("_limit") - F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        .filter(F.col("_room") > 0)
    )
    kept = slotted.filter(counted).join(room, "_slot")
    whole = kept.filter(F.col("_n") <= F.col("_room"))
    cut = kept.filter(F.col("_n") > F.col("_room"))
    cut = cut.withColumn("_rn", F.row_number().over(W.partitionBy("_slot").orderBy("_hash", *order)))
    cut = cut.filter(F.col("_rn") <= F.col("_room")).drop("_rn")
    return whole.unionByName(cut).drop("_hash", "_slot", "_n", "_limit", "_room")


def global_index(df: DataFrame, *by: Column, out: str = "index") -> DataFrame:
    """``df`` with ``out``, its place from 0 in the order of ``by``, which should leave no ties.

    The rows are sorted in ranges and numbered inside each; only the counts of the ranges, a row for
    each, meet in one place. The sorted rows are staged, as ranges are drawn from a sample.
    """
    ordered = staged(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    index = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(out, index).drop("_id", "_part", "_before")


def hash_batches(df: DataFrame, order: Sequence[Column], size: int, out: str = "batch") -> DataFrame:
    """Rows in batches of exactly ``size`` (the last: the rest) in the given order, at any number of rows."""
    return global_index(df, *order, out=out).withColumn(out, F.floor(F.col(out) / F.lit(size)))


def dense_index(ids: DataFrame, column: str, out: str = "idx", start: int = 0) -> DataFrame:
    """Distinct ids numbered start, start+1, ... in id order, however they are spread."""
    rows = global_index(ids.select(column).distinct(), F.col(column), out=out)
    return rows.select(column, (F.col(out) + start).cast("long").alias(out))
