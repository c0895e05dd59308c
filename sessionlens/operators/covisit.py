"""Item-item co-visitation: which items turn up near each other in session tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.config import COVISIT, COVISIT_TYPE_WEIGHT, TYPES, CovisitSpec
from sessionlens.functions.columns import round6, seconds
from sessionlens.operators.ranking import dealt, top_n
from sessionlens.sources.sinks import staged


SUM_BASE = 1_600_000_000  # seconds taken off before times are summed, to stay far below 2^63


def session_tail(events: DataFrame, n: int = 30) -> DataFrame:
    """Newest ``n`` events of each session, numbered from 1 (newest)."""
    newest_first = [F.desc("ts"), F.desc("aid"), F.desc("type")]
    return top_n(events, ["session"], newest_first, n, out="n")


def item_pairs(events: DataFrame, spec: CovisitSpec) -> DataFrame:
    """Ordered pairs of different items of one session tail within the time window.

    A tail has at most ``spec.tail`` rows, so a session gives at most tail^2 pairs however long it
    is, and both sides of the join come from one shuffle by session, in partitions whose number follows that of the
    tail rows. Types are filtered before the tail is taken.
    """
    if set(spec.types) != set(TYPES):
        events = events.filter(F.col("type").isin(*spec.types))
    tail = session_tail(events, spec.tail).select("session", "aid", seconds(F.col("ts")).alias("ts"), "type")
    tail = dealt(tail, "session")
    x = tail.select("session", F.col("aid").alias("aid_x"), F.col("ts").alias("ts_x"))
    y = tail.select(
        "session", F.col("aid").alias("aid_y"), F.col("ts").alias("ts_y"), F.col("type").alias("type_y")
    )
    near = F.abs(F.col("ts_x") - F.col("ts_y")) < spec.window_ms // 1000
    return x.join(y, "session").filter(near & (F.col("aid_x") != F.col("aid_y")))


def time_span(events: DataFrame, span: tuple[int, int] | None = None) -> tuple[Column, Column]:
    """First and last second of the log: given, or from one scalar subquery of the plan."""
    if span is not None:
        return F.lit(span[0]), F.lit(span[1])
    second = seconds(F.col("ts"))
    ends = events.agg(F.struct(F.min(second).alias("start"), F.max(second).alias("end"))).scalar()
    return ends["start"], ends["end"]


def edge_counts(events: DataFrame, spec: CovisitSpec) -> DataFrame:
    """What all weightings need of a pair of items (aid_x, aid_y): in how many sessions it occurs (n), the
    sum of its latest times there, and the sessions where aid_y occurs in it with each type.

    A session counts once whatever its number of pairs. Whole numbers are summed, so the result does not
    depend on the order of addition.
    """
    edge = ["aid_x", "aid_y"]
    kinds = [F.max(F.col("type_y") == t).cast("long").alias(t) for t in TYPES]
    by_session = item_pairs(events, spec).groupBy("session", *edge).agg(F.max("ts_x").alias("ts_x"), *kinds)
    since = F.sum(F.col("ts_x") - SUM_BASE).alias("since_base")
    return by_session.groupBy(*edge).agg(F.count(F.lit(1)).alias("n"), since, *[F.sum(t).alias(t) for t in TYPES])


def pair_weights(
    edges: DataFrame, weighting: str, events: DataFrame, span: tuple[int, int] | None = None
) -> DataFrame:
    """Sparse item-item matrix (aid_x, aid_y, wgt) from ``edge_counts``; weights are linear in the counts."""
    if weighting == "recency":
        start, end = time_span(events, span)
        age = F.col("since_base") - F.col("n") * (start - SUM_BASE)
        wgt = F.col("n") + F.lit(3.0).cast("double") * age / F.greatest(end - start, F.lit(1))
    elif weighting == "type":
        weights = COVISIT_TYPE_WEIGHT.items()
        wgt = sum((F.col(t) * F.lit(w).cast("double") for t, w in weights), F.lit(0.0).cast("double"))
    else:
        wgt = sum((F.col(t) for t in TYPES), F.lit(0))
    return edges.select("aid_x", "aid_y", round6(wgt).alias("wgt"))


def heaviest(weights: DataFrame, n: int) -> DataFrame:
    """The ``n`` heaviest partners of each item, numbered from 1."""
    return top_n(weights, ["aid_x"], [F.desc("wgt"), F.asc("aid_y")], n, out="n")


def covisit(
    events: DataFrame,
    mode: str = "clicks",
    spec: CovisitSpec | None = None,
    span: tuple[int, int] | None = None,
) -> DataFrame:
    """Neighbours (aid_x, aid_y, wgt, n): the ``top_n`` heaviest partners of each item, n from 1."""
    spec = spec or COVISIT[mode]
    weights = pair_weights(edge_counts(events, spec), spec.weighting, events, span)
    return heaviest(weights, spec.top_n)


def covisit_by_day(events: DataFrame, span: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The clicks and the carts_orders matrix. Both weigh the same pairs, which are counted and staged once."""
    spec, other = COVISIT["clicks"], COVISIT["carts_orders"]
    assert (spec.window_ms, spec.types, spec.tail) == (other.window_ms, other.types, other.tail)
    edges = staged(edge_counts(events, spec))
    both = (heaviest(pair_weights(edges, x.weighting, events, span), x.top_n) for x in (spec, other))
    return tuple(both)
