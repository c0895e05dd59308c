"""Exact best sums over posting lists, each read only as far as it can matter.

A list holds the successors of an item by falling probability. A session's score of an item is the sum of what its
own lists say, weighted. After the first places of its lists a session knows k scores that are reached already; an item not seen
yet can reach no more than the sum of the next places. A session whose unread bound is below its k-th score stops; the
others read on, four times as far each round. What was seen in some lists only is completed by looking its other entries up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.columns import round6
from sessionlens.operators.ranking import global_index, top_n
from sessionlens.sources.sinks import staged

FIRST = 256  # places of a list that every session reads
GROWTH = 4


def posting_lists(model: DataFrame) -> DataFrame:
    """(aid, place, aid_next, p): successors numbered from 0 by falling probability, ties by id.

    All rows are sorted in ranges, so an item with very many successors is no task of its own.
    """
    placed = global_index(model.select("aid", "aid_next", "p"), F.col("aid"), F.desc("p"), F.col("aid_next"))
    placed = staged(placed)
    starts = placed.groupBy("aid").agg(F.min("index").alias("start"))
    return staged(placed.join(starts, "aid").select("aid", (F.col("index") - F.col("start")).alias("place"), "aid_next", "p"))


def best_sums(tails: DataFrame, lists: DataFrame, k: int, first: int = FIRST, log: list | None = None) -> DataFrame:
    """(session, aid_next, score, rank): the ``k`` best sums of p / back over the lists of each session's items.

    ``tails`` has (session, aid, back), items once in a session and back from 1 to at most 62. Scores are rounded to six places and
    ties go to the lower id, as if all lists had been read. ``log`` gets (from, to, sessions) of every round.
    """
    open_, seen, done, bounds = tails.select("session", "aid", "back"), None, [], []
    start, stop = 0, first
    while True:
        block = lists.where((F.col("place") >= start) & (F.col("place") < stop))
        bit = F.expr("shiftleft(1L, cast(back as int))")
        read = open_.join(block, "aid").groupBy("session", "aid_next").agg(F.sum(F.col("p") / F.col("back")).alias("part"), F.bit_or(bit).alias("found"))
        if seen is not None:
            read = seen.unionByName(read).groupBy("session", "aid_next").agg(F.sum("part").alias("part"), F.bit_or("found").alias("found"))
        seen = staged(read)
        onward = lists.where(F.col("place") == stop).select("aid", F.col("p").alias("next"))
        unread = F.collect_list(F.struct("aid", "back", (F.col("next") / F.col("back")).alias("most")))  # a session's tail is bounded
        ahead = open_.join(onward, "aid").groupBy("session").agg(unread.alias("unread"), F.sum(F.col("next") / F.col("back")).alias("rest"))
        kth = top_n(seen.select("session", "aid_next", round6(F.col("part")).alias("part")), ["session"], [F.desc("part"), F.asc("aid_next")], k)
        kth = kth.where(F.col("rank") == k).select("session", F.col("part").alias("least"))
        state = staged(ahead.join(kth, "session", "left").withColumn("on", F.col("least").isNull() | (round6(F.col("rest")) >= F.col("least"))))
        more = state.where("on").select("session")
        active = more.count()
        if log is not None:
            log.append((start, stop, active))
        bounds.append(state.where("not on").select("session", "least", "unread"))
        if not active:
            done.append(seen)
            break
        done.append(seen.join(more, "session", "left_anti"))
        seen, open_ = staged(seen.join(more, "session", "left_semi")), staged(open_.join(more, "session", "left_semi"))
        start, stop = stop, stop * GROWTH
    found, limits = done[0], bounds[0]
    for d, b in zip(done[1:], bounds[1:]):
        found, limits = found.unionByName(d), limits.unionByName(b)

    # What was not found in a list that was left may still be there, further down.
    found = found.join(limits, "session", "left").withColumn("open", F.expr("filter(unread, u -> shiftleft(1L, cast(u.back as int)) & found = 0)"))
    most = F.col("part") + F.expr("coalesce(aggregate(open, 0D, (s, u) -> s + u.most), 0D)")
    found = staged(found.where(F.col("least").isNull() | (round6(most) >= F.col("least"))).select("session", "aid_next", "part", "open"))
    asked = found.where(F.size("open") > 0).select("session", "aid_next", F.inline("open"))
    extra = asked.join(lists.select("aid", "aid_next", "p"), ["aid", "aid_next"]).groupBy("session", "aid_next").agg(F.sum(F.col("p") / F.col("back")).alias("extra"))
    scored = found.join(extra, ["session", "aid_next"], "left").select("session", "aid_next", round6(F.col("part") + F.coalesce("extra", F.lit(0.0))).alias("score"))
    return top_n(scored, ["session"], [F.desc("score"), F.asc("aid_next")], k)
