"""Candidate generators: ranked (session, aid[, type], rank) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.config import DEFAULTS, TYPES
from sessionlens.functions.columns import round6
from sessionlens.functions.lists import ordered_list
from sessionlens.operators.postings import FIRST, best_sums, posting_lists
from sessionlens.operators.ranking import dealt, top_n
from sessionlens.operators.timeline import event_runs, numbered, with_positions
from sessionlens.sources.sinks import staged

BOUGHT = ("carts", "orders")
LONG = 4096  # items of a history from which its votes are counted in more than one task


def session_items(events: DataFrame) -> DataFrame:
    """Each item of a session once, with its first and last time."""
    return events.groupBy("session", "aid").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def recent_unique_items(events: DataFrame) -> DataFrame:
    """Items of a session, newest last occurrence first, numbered from 1."""
    items = session_items(events).select("session", "aid", "last_ts")
    position = (F.col("pos_from_end") + 1).alias("position")
    return numbered(items, "last_ts").select("session", "aid", "last_ts", position)


CHUNK = 64  # neighbours of an item in a list


def _votes(items: DataFrame, neighbours: DataFrame, count: int | None = None) -> DataFrame:
    """One row per (history item, neighbour of the same ``source``). ``at`` is the place of the vote in a walk over the items,
    newest first, and down the neighbour list of each. One long, so that votes are counted in a
    hash table; a struct would make Spark sort them all. Lists of 2^24 neighbours or more are an error.

    A row meets its neighbours in lists. With ``count`` the number of items, rows are dealt by session before they
    become votes, which then need no shuffle.
    """
    near = F.collect_list(F.struct("aid_y", "n")).alias("near")
    hop = neighbours.groupBy("source", F.col("aid_x").alias("aid"), F.floor(F.col("n") / CHUNK).alias("chunk")).agg(near)
    met = items.join(hop, ["source", "aid"]).select("source", "session", "position", "near")
    if count is not None:
        met = dealt(met, "session", count=count)
    met = met.select("source", "session", "position", F.inline("near"))
    fits = (F.col("n") < 1 << 24) & (F.col("position") < 1 << 36)
    at = F.col("source") * F.lit(1 << 60) + F.col("position") * F.lit(1 << 24) + F.col("n")
    at = F.when(fits, at).otherwise(F.raise_error(F.lit("a neighbour list or a history is too long")))
    return met.select("session", "aid_y", at.alias("at"))


def _tally(votes: DataFrame, k: int) -> DataFrame:
    """Most voted items of each session; equal counts keep the order of their first vote."""
    counted = votes.groupBy("session", "aid_y").agg(F.count(F.lit(1)).alias("cnt"), F.min("at").alias("at"))
    best = top_n(counted, ["session"], [F.desc("cnt"), F.asc("at")], k)
    return best.select("session", F.col("aid_y").alias("aid"), "rank")


def _sourced(*tables: DataFrame) -> DataFrame:
    """The tables as one, with ``source`` their number."""
    return reduce(DataFrame.unionByName, [t.withColumn("source", F.lit(i).cast("long")) for i, t in enumerate(tables)])


def _elected(items: DataFrame, neighbours: DataFrame, k: int) -> DataFrame:
    """``_tally`` of the votes of the histories ``items``.

    Those of most sessions are counted in the part that has the session; sessions with a LONG history by (session, neighbour).
    """
    items = staged(items.select("source", "session", "aid", "position"))
    n = items.count()
    long_ = items.filter(F.col("position") > LONG).select("session").distinct()
    if long_.isEmpty():
        return _tally(_votes(items, neighbours, n), k)
    usual, hot = items.join(long_, "session", "left_anti"), items.join(long_, "session", "left_semi")
    return _tally(_votes(usual, neighbours, n), k).unionByName(_tally(_votes(hot, neighbours), k))


def suggest_clicks(events: DataFrame, neighbours: DataFrame, k: int = DEFAULTS.candidates) -> DataFrame:
    """Vote of the neighbours of every item in the history. Serves embedding neighbours as well."""
    return _elected(_sourced(recent_unique_items(events)), _sourced(neighbours), k)


def suggest_buys(
    events: DataFrame, neighbours: DataFrame, bought_neighbours: DataFrame, k: int = DEFAULTS.candidates
) -> DataFrame:
    """One vote of the neighbours of all items and the buy-to-buy neighbours of bought items."""
    bought = recent_unique_items(events.filter(F.col("type").isin(*BOUGHT)))
    near = [n.select("aid_x", "aid_y", "n") for n in (neighbours, bought_neighbours)]
    return _elected(_sourced(recent_unique_items(events), bought), _sourced(*near), k)


def for_types(candidates: DataFrame, types=TYPES) -> DataFrame:
    """The same ranked list for several objectives."""
    return candidates.withColumn("type", F.explode(F.array(*[F.lit(t) for t in types])))


def candidates_by_type(clicks: DataFrame, buys: DataFrame) -> DataFrame:
    both = for_types(clicks, ("clicks",)).unionByName(for_types(buys, BOUGHT))
    return both.select("session", "type", "aid", "rank")


def last_item(events: DataFrame) -> DataFrame:
    newest = F.max(F.struct("ts", "aid"))["aid"]
    return events.groupBy("session").agg(newest.alias("aid"))


def last_item_candidates(
    events: DataFrame, neighbours: DataFrame, k: int = DEFAULTS.last_item_candidates
) -> DataFrame:
    """Neighbours of the newest item, in neighbour order."""
    hop = neighbours.filter(F.col("n") <= k).select(F.col("aid_x").alias("aid"), "aid_y", "n")
    return last_item(events).join(hop, "aid").select(
        "session", F.col("aid_y").alias("aid"), F.col("n").cast("long").alias("rank")
    )


def next_item_pairs(events: DataFrame) -> DataFrame:
    """Consecutive items of a session (session, ts, pos, aid, aid_next)."""
    moves = with_positions(events).filter(F.col("next_aid").isNotNull())
    return moves.select("session", "ts", "pos", "aid", F.col("next_aid").alias("aid_next"))


def move_counts(events: DataFrame) -> DataFrame:
    """How often an item directly follows another (aid, aid_next, moves). Copies of an event follow
    each other, which adds n - 1 moves from the item to itself without unfolding them."""
    runs = event_runs(events).select("aid", "next_aid", "n")
    repeats = F.struct(F.col("aid").alias("aid_next"), (F.col("n") - 1).alias("moves"))
    onward = F.struct(F.col("next_aid").alias("aid_next"), F.lit(1).cast("long").alias("moves"))
    steps = runs.select("aid", F.inline(F.array(repeats, onward)))
    steps = steps.filter((F.col("moves") > 0) & F.col("aid_next").isNotNull())
    return steps.groupBy("aid", "aid_next").agg(F.sum("moves").alias("moves"))


def transitions(events: DataFrame) -> DataFrame:
    """Next-item model: every successor of each item and its share (aid, aid_next, p)."""
    moves = move_counts(events)
    totals = moves.groupBy("aid").agg(F.sum("moves").alias("total"))
    return moves.join(totals, "aid").select("aid", "aid_next", (F.col("moves") / F.col("total")).alias("p"))


def sequence_tail(events: DataFrame, n: int = DEFAULTS.history_tail) -> DataFrame:
    """Last ``n`` items of a session in order of first occurrence; back = 1 for the last one."""
    return top_n(session_items(events), ["session"], [F.desc("first_ts"), F.desc("aid")], n, out="back")


SMALL_MODEL = 1 << 18  # moves, 8 MB of them, that may go to all executors


def sequence_candidates(
    events: DataFrame, model: DataFrame, n: int = DEFAULTS.history_tail, k: int = DEFAULTS.candidates, first: int = FIRST
) -> DataFrame:
    """Next items scored by transition probability, later history items weighing more (1/back).

    Where an item has more than ``first`` successors, its list is read only as far as it can still change a session's
    best ``k``; the result is the same. Sums are made in parts that have the session: a small model comes to the tails, else the tails
    get the lists of their items before they are dealt.
    """
    tails = sequence_tail(events, n)
    longest, moves = model.groupBy("aid").count().agg(F.max("count"), F.sum("count")).first()
    if (longest or 0) > first:
        best = best_sums(tails, posting_lists(model), k, first)
    else:
        if (moves or 0) <= SMALL_MODEL:
            met = dealt(tails, "session").join(F.broadcast(model), "aid")
        else:
            tails = staged(tails)
            lists = model.groupBy("aid").agg(F.collect_list(F.struct("aid_next", "p")).alias("next"))  # ``first`` at most
            met = dealt(tails.join(lists, "aid"), "session", count=tails.count())
            met = met.select("session", "back", F.inline("next"))
        scored = met.groupBy("session", "aid_next").agg(round6(F.sum(F.col("p") / F.col("back"))).alias("score"))
        best = top_n(scored, ["session"], [F.desc("score"), F.asc("aid_next")], k)
    return best.select("session", F.col("aid_next").alias("aid"), "rank")


def nest(candidates: DataFrame) -> DataFrame:
    """Ranked rows as one list per session (at most k items each, k being the generator's bound)."""
    return candidates.groupBy("session").agg(ordered_list(F.col("rank"), F.col("aid")).alias("labels"))


def popular_items(base: DataFrame, settings=DEFAULTS) -> DataFrame:
    """Best sellers overall and on each of the days, ``popular_rank`` of each, ties by item: a bounded list.

    ``base`` has the events of (session, aid, day) by type (``item_days``); items without orders are not popular.
    """
    sold = base.filter(F.col("orders_cnt") > 0).groupBy("num", "aid").agg(F.sum("orders_cnt").alias("sold"))
    order = [F.desc("sold"), F.asc("aid")]
    daily = top_n(sold.filter(F.col("num") <= settings.n_days), ["num"], order, settings.popular_rank)
    ever = sold.groupBy("aid").agg(F.sum("sold").alias("sold")).orderBy(*order).limit(settings.popular_rank)
    return daily.select("aid").union(ever.select("aid")).distinct()


def popular_candidates(events: DataFrame, popular: DataFrame) -> DataFrame:
    """Every session with every popular item. The items are few by construction and come as one array
    from a scalar subquery, so sessions are neither joined nor shuffled for it.
    """
    items = popular.agg(F.sort_array(F.collect_list("aid")).alias("aids")).scalar()
    return events.select("session").distinct().select("session", F.explode(items).alias("aid"))


def covisit_rank_pivot(typed: DataFrame) -> DataFrame:
    """One row per (session, aid) with its rank in the list of each objective."""
    ranks = [F.max(F.when(F.col("type") == t, F.col("rank"))).alias(f"covisit_{t}_candidate_num") for t in TYPES]
    return typed.filter(F.col("aid").isNotNull()).groupBy("session", "aid").agg(*ranks)


def tall_source(candidates: DataFrame, slot: str, max_rank: int | None = None) -> DataFrame:
    """Ranked candidates as rows (session, aid, slot, rank), optionally only the best ranks."""
    rows = candidates.filter(F.col("aid").isNotNull())
    if max_rank is not None:
        rows = rows.filter(F.col("rank") <= max_rank)
    return rows.select("session", "aid", F.lit(slot).alias("slot"), F.col("rank").cast("long").alias("rank"))


def tall_covisit(typed: DataFrame) -> DataFrame:
    rows = typed.filter(F.col("aid").isNotNull())
    return rows.select("session", "aid", F.concat(F.lit("covisit_"), "type").alias("slot"), "rank")
