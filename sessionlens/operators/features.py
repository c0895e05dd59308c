"""Session, item and session-item features from one shared aggregate.

``item_days`` counts events per (session, aid, day); everything else that counts rolls it up. Rows of
a hot session or item are combined before each shuffle, and distinct counts become counts of
rows of a finer aggregate, so no query expands its input for COUNT(DISTINCT). Families of like columns
are written as SQL text, which the driver builds much faster than chains of column calls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.config import DEFAULTS, RECENCY_TYPE_WEIGHT, TYPES, UNRANKED, Settings
from sessionlens.functions import columns as C
from sessionlens.operators.ranking import competition_ranks
from sessionlens.operators.timeline import event_runs, with_positions

RECENCY = (
    "action_num_reverse_chrono",
    "sec_since_session_start",
    "sec_to_session_end",
    "log_recency_score",
    "type_weighted_log_recency_score",
)
STEPS = (("clicks", "carts"), ("carts", "orders"))
RATIOS = (("clicks", "carts"), ("carts", "orders"), ("clicks", "orders"))
STATS = ("avg", "min", "max")


def _days(settings: Settings) -> range:
    return range(1, settings.n_days + 1)


def _exprs(*texts: str) -> list[Column]:
    return [F.expr(text) for text in texts]


def _ratio(numerator: str, denominator: str, name: str, default: str = "null") -> str:
    return f"round(if({denominator} = 0, {default}, {numerator} / {denominator}), 6) as {name}"


def day_numbers(events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Local days of the log numbered from 1; one row per calendar day."""
    dt = C.local_day(F.col("ts"), settings.day_offset_hours)
    days = events.select(dt.alias("dt")).distinct()
    return days.select("dt", F.row_number().over(W.orderBy("dt")).cast("long").alias("num"))


def item_days(events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Events of each type and their first time per (session, aid, local day), with the day number."""
    dt = C.local_day(F.col("ts"), settings.day_offset_hours)
    counts = _exprs(*[f"count_if(type = '{t}') as {t}_cnt" for t in TYPES])
    firsts = _exprs(*[f"min(if(type = '{t}', ts, null)) as first_{t}_ts" for t in TYPES])
    base = events.groupBy("session", "aid", dt.alias("dt")).agg(*counts, *firsts)
    return base.join(F.broadcast(day_numbers(events, settings)), "dt")  # one row per calendar day


def session_item_totals(base: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The base over days: counts, counts by day, first times and the delays between them.

    A delay counts only if the later step really came later.
    """
    days = [(t, d) for t in TYPES for d in _days(settings)]
    rolled = base.groupBy("session", "aid").agg(
        *_exprs(
            *[f"sum({t}_cnt) as {t}_cnt" for t in TYPES],
            *[f"sum(if(num = {d}, {t}_cnt, 0L)) as {t}_cnt_day{d}" for t, d in days],
            *[f"min(first_{t}_ts) as first_{t}_ts" for t in TYPES],
            "min(num) as min_num",
            "max(num) as max_num",
        )
    )
    gaps = {(a, b): f"first_{b}_ts - first_{a}_ts" for a, b in STEPS}
    rolled = rolled.selectExpr("*", *[f"if({g} > 0, {g}, null) as sec_{a}_{b}" for (a, b), g in gaps.items()])
    return rolled.drop(*[f"first_{t}_ts" for t in TYPES])


def _funnel(prefix: str) -> list[Column]:
    steps = [(f"{a}_{b}", s) for a, b in STEPS for s in STATS]
    value = {"avg": "round(avg(sec_{}), 6)", "min": "min(sec_{})", "max": "max(sec_{})"}
    return _exprs(*[f"{value[s].format(step)} as {s}_sec_{prefix}{step}" for step, s in steps])


def session_day_counts(totals: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return totals.groupBy("session").agg(*_session_days(settings))


def _session_days(settings: Settings) -> list[Column]:
    names = [f"{t}_cnt_day{d}" for t in TYPES for d in _days(settings)]
    return _exprs(*[f"sum({n}) as session_{n}" for n in names])


def session_stats(totals: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Day span, counts, distinct items, ratios and funnel delays of each session."""
    stats = totals.groupBy("session").agg(
        *_exprs("min(min_num) as min_day_num", "max(max_num) as max_day_num"),
        *_session_days(settings),
        *_exprs(*[f"sum({t}_cnt) as session_{t}_cnt" for t in TYPES]),
        *_exprs(*[f"count_if({t}_cnt > 0) as session_{t}_unique_aid" for t in TYPES]),
        *_funnel("session_"),
    )
    unique = "session_{}_unique_aid".format
    return stats.selectExpr("*", *[_ratio(unique(b), unique(a), f"session_{a}_{b}_ratio") for a, b in RATIOS])


def session_funnel(totals: DataFrame) -> DataFrame:
    return totals.groupBy("session").agg(*_funnel("session_"))


def item_funnel(totals: DataFrame) -> DataFrame:
    return totals.groupBy("aid").agg(*_funnel(""))


def _item_counts() -> list[Column]:
    """Events and distinct sessions per item over rows that hold one session each."""
    counts = [f"sum({t}_cnt) as {t}_cnt" for t in TYPES]
    return _exprs(*counts, *[f"count_if({t}_cnt > 0) as {t}_uu" for t in TYPES])


MEASURES = [f"{t}_cnt" for t in TYPES] + [f"{t}_uu" for t in TYPES]


def _rank_name(measure: str) -> str:
    return measure.replace("_cnt", "_rank") if measure.endswith("_cnt") else f"{measure}_rank"


def _pivot_ranks(tall: DataFrame, keys: list[str]) -> DataFrame:
    picks = [f"max(if(measure = '{m}', rank, null)) as {_rank_name(m)}" for m in MEASURES]
    return tall.groupBy(*keys).agg(*_exprs(*picks))


def daily_item_rank(base: DataFrame) -> DataFrame:
    """Rank of every item among the items of its day, for six measures."""
    counts = base.groupBy("dt", "num", "aid").agg(*_item_counts())
    tall = competition_ranks(counts, ["aid"], MEASURES, within=["dt", "num"])
    return _pivot_ranks(tall, ["dt", "num", "aid"]).withColumnRenamed("num", "day_num")


def item_rank_by_day(base: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Ranks by event counts, one column per type and day."""
    counts = base.groupBy("num", "aid").agg(*_item_counts())
    measures = MEASURES[: len(TYPES)]
    tall = competition_ranks(counts, ["aid"], measures, within=["num"])
    return tall.groupBy("aid").agg(*_day_ranks(settings))


def _day_ranks(settings: Settings) -> list[Column]:
    days = [(t, d) for t in TYPES for d in _days(settings)]
    pick = "max(if(measure = '{0}_cnt' and num = {1}, rank, null)) as {0}_rank_day{1}".format
    return _exprs(*[pick(t, d) for t, d in days])


def item_stats(base: DataFrame, totals: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Popularity ranks (overall and by day), events per user, ratios and funnel delays of each item.

    Overall figures go through the same ranking as daily ones, under day number 0.
    """
    whole = totals.groupBy("aid").agg(*_item_counts(), *_funnel(""))
    per_user = [_ratio(f"{t}_cnt", f"{t}_uu", f"avg_{t}_cnt", default="0D") for t in TYPES]
    ratios = [_ratio(f"{b}_uu", f"{a}_uu", f"{a}_{b}_ratio") for a, b in RATIOS]

    daily = base.groupBy("num", "aid").agg(*_item_counts())
    ranked = daily.unionByName(whole.selectExpr("0L as num", "aid", *MEASURES))
    tall = competition_ranks(ranked, ["aid"], MEASURES, within=["num"])
    overall = [f"max(if(num = 0 and measure = '{m}', rank, null)) as {_rank_name(m)}" for m in MEASURES]
    ranks = tall.groupBy("aid").agg(*_exprs(*overall), *_day_ranks(settings))
    return whole.selectExpr("*", *per_user, *ratios).drop(*MEASURES).join(ranks, "aid")


def session_recency(events: DataFrame) -> DataFrame:
    """Each event with its place in the session and two recency scores."""
    placed = with_positions(events)
    recency = C.log_recency(F.col("pos_from_end"), F.col("length"))
    return placed.select(
        "session",
        "aid",
        "ts",
        "type",
        F.col("pos_from_end").alias("action_num_reverse_chrono"),
        (F.col("ts") - F.col("start_ts")).alias("sec_since_session_start"),
        (F.col("end_ts") - F.col("ts")).alias("sec_to_session_end"),
        F.col("length").alias("session_interaction_length"),
        recency.alias("log_recency_score"),
        C.weighted_recency(F.col("type"), recency).alias("type_weighted_log_recency_score"),
    )


def session_item_stats(events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Recency and counts (total and by day) of each item of a session.

    Works on folded copies: a run of n copies takes n neighbouring places, so its smallest, largest
    and summed measures follow from its ends.
    """
    dt = C.local_day(F.col("ts"), settings.day_offset_hours)
    runs = event_runs(events).withColumn("dt", dt)
    runs = runs.join(F.broadcast(day_numbers(events, settings)), "dt")  # one row per calendar day
    oldest = F.col("length") - F.col("pos") - 1
    runs = runs.select(
        "session",
        "aid",
        "type",
        "num",
        "n",
        "length",
        oldest.alias("oldest"),
        (oldest - F.col("n") + 1).alias("newest"),
        (F.col("ts") - F.col("start_ts")).alias("since"),
        (F.col("end_ts") - F.col("ts")).alias("left"),
        C.type_weight(F.col("type"), RECENCY_TYPE_WEIGHT).alias("w"),
    )
    length = F.col("length")
    runs = runs.withColumns(
        {"low": C.log_recency(F.col("oldest"), length), "high": C.log_recency(F.col("newest"), length)}
    )
    runs = runs.withColumn("total", C.log_recency_sum(F.col("low"), F.col("n"), length))
    measures = {  # smallest, largest and sum over the copies of a run
        "action_num_reverse_chrono": ("newest", "oldest", "n * (newest + oldest) / 2"),
        "sec_since_session_start": ("since", "since", "n * since"),
        "sec_to_session_end": ("left", "left", "n * left"),
        "log_recency_score": ("round(low, 6)", "round(high, 6)", "total"),
        "type_weighted_log_recency_score": ("round(w * low, 6)", "round(w * high, 6)", "w * total"),
    }
    recency = []
    for name, (smallest, largest, total) in measures.items():
        recency += [
            f"round(sum({total}) / sum(n), 6) as avg_{name}",
            f"min({smallest}) as min_{name}",
            f"max({largest}) as max_{name}",
        ]
    counts = [f"sum(if(type = '{t}', n, 0L)) as session_aid_{t}_cnt" for t in TYPES]
    by_day = [
        f"sum(if(type = '{t}' and num = {d}, n, 0L)) as session_aid_{t}_cnt_day{d}"
        for t in TYPES
        for d in _days(settings)
    ]
    return runs.groupBy("session", "aid").agg(*_exprs(*recency, *counts, *by_day))


def slot_column(slot: str) -> str:
    return f"{slot}_candidate_num"


def merge_candidates(sources: list[DataFrame], popular: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Candidates of all sources, one row per (session, aid) and one rank column per slot.

    ``sources`` hold rows (session, aid, slot, rank). Slots nobody fills stay NULL.
    """
    rows = [s.select("session", "aid", "slot", "rank") for s in sources]
    if popular is not None:
        unranked = F.lit(None).cast("string").alias("slot"), F.lit(None).cast("long").alias("rank")
        rows.append(popular.select("session", "aid", *unranked))
    ranks = _exprs(*[f"max(if(slot = '{s}', rank, null)) as {slot_column(s)}" for s in settings.slots])
    return reduce(DataFrame.unionByName, rows).groupBy("session", "aid").agg(*ranks)


def candidate_union(history: DataFrame, merged: DataFrame) -> DataFrame:
    """Ranked candidates together with the items already in the history and their statistics."""
    return merged.join(history, ["session", "aid"], "full_outer")


def feature_columns(settings: Settings = DEFAULTS) -> list[tuple[str, object]]:
    """Columns of the feature table in order, each with the value that stands in for NULL."""
    days = list(_days(settings))
    cols: list[tuple[str, object]] = [("min_day_num", None), ("max_day_num", None)]
    cols += [(f"session_{t}_cnt_day{d}", 0) for t in TYPES for d in days]
    cols += [(f"session_{t}_cnt", None) for t in TYPES]
    cols += [(f"session_{t}_unique_aid", None) for t in TYPES]
    cols += [(f"session_{a}_{b}_ratio", None) for a, b in RATIOS]
    cols += [(f"{s}_sec_session_{a}_{b}", None) for a, b in STEPS for s in STATS]
    cols += [(f"session_aid_{t}_cnt", 0) for t in TYPES]
    cols += [(f"{s}_{m}", None) for m in RECENCY for s in STATS]
    cols += [(f"session_aid_{t}_cnt_day{d}", 0) for t in TYPES for d in days]
    cols += [(slot_column(s), None) for s in settings.slots]
    cols += [(f"{t}_rank", UNRANKED) for t in TYPES] + [(f"{t}_uu_rank", UNRANKED) for t in TYPES]
    cols += [(f"avg_{t}_cnt", 0) for t in TYPES]
    cols += [(f"{a}_{b}_ratio", None) for a, b in RATIOS]
    cols += [(f"{s}_sec_{a}_{b}", None) for a, b in STEPS for s in STATS]
    cols += [(f"{t}_rank_day{d}", UNRANKED) for t in TYPES for d in days]
    return cols


def candidate_features(
    union: DataFrame, sessions: DataFrame, items: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Feature table keyed by (session, aid).

    Popular items stand in every session and hot sessions have many candidates; both joins are
    left outer with one right row per key, the shape in which adaptive execution splits hot keys.
    """
    joined = union.join(sessions, "session", "left").join(items, "aid", "left")
    filled = [
        name if default is None else f"coalesce({name}, {default}) as {name}"
        for name, default in feature_columns(settings)
    ]
    return joined.selectExpr("session", "aid", *filled)


def compact(features: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Narrow types for storage: day numbers as short, other whole numbers but times as int, the rest as double.

    A number that does not fit its type is an error; none is changed.
    """
    whole = {n for n, d in feature_columns(settings) if n.endswith(("_cnt", "_unique_aid", "_rank")) and not n.startswith("avg_")}
    whole |= {n for n, _ in feature_columns(settings) if "_cnt_day" in n or "_rank_day" in n}
    out = []
    for name in features.columns:
        col = F.col(name)
        if name in whole or name in ("min_day_num", "max_day_num"):
            high = 2**31 - 1 if name in whole else 2**15 - 1
            fits = F.when(col.isNull() | col.between(-high, high), col)
            col = F.coalesce(fits, F.when(col.isNotNull(), F.raise_error(F.lit(f"{name} does not fit"))).cast("long"))
            col = col.cast("int" if name in whole else "short")
        elif name not in ("session", "aid"):
            col = col.cast("double")
        out.append(col.alias(name))
    return features.select(*out)
