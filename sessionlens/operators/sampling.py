"""Labels on candidates, negative sampling, splits and filters of training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.config import DEFAULTS, TYPES
from sessionlens.functions.columns import count_when, stable_hash
from sessionlens.operators.candidates import next_item_pairs
from sessionlens.operators.ranking import global_index, hash_batches, smallest, top_n_by
from sessionlens.operators.timeline import with_positions
from sessionlens.sources.sinks import drop_staged, staged


def join_labels(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """Candidates with the type they are a label of (NULL: none; one row per type if several)."""
    return candidates.join(labels.select("session", "aid", "type"), ["session", "aid"], "left")


def labeled_candidates(candidates: DataFrame, labels: DataFrame, type_: str) -> DataFrame:
    """Candidates with gt = 1 where they are a label of one objective, else 0."""
    hits = labels.filter(F.col("type") == type_).select("session", "aid", F.lit(1).alias("gt"))
    joined = candidates.join(hits, ["session", "aid"], "left")
    return joined.withColumn("gt", F.coalesce("gt", F.lit(0)).cast("long"))


def target_sessions(joined: DataFrame, type_: str) -> DataFrame:
    """Sessions with a candidate that is a label of ``type_``, and their hits of each type."""
    counts = [count_when(F.col("type") == t).alias(f"{t}_cnt") for t in TYPES]
    hits = joined.filter(F.col("type").isNotNull()).groupBy("session").agg(*counts)
    return hits.filter(F.col(f"{type_}_cnt") > 0)


def positive_list(joined: DataFrame, targets: DataFrame, type_: str) -> DataFrame:
    hits = joined.filter(F.col("type") == type_).select("session", "aid")
    return hits.join(targets, "session", "left_semi")


def negative_list(
    joined: DataFrame,
    targets: DataFrame,
    type_: str,
    per_positive: int = DEFAULTS.negatives_per_positive,
    seed: int = 0,
) -> DataFrame:
    """Up to ``per_positive`` candidates per hit that are a label of no type, in random (hash) order."""
    quota = targets.select("session", (F.col(f"{type_}_cnt") * per_positive).alias("quota"))
    free = joined.filter(F.col("type").isNull()).select("session", "aid").join(quota, "session")
    order = [stable_hash(F.col("session"), F.col("aid"), seed=seed), F.asc("aid")]
    return top_n_by(free, ["session"], order, F.col("quota"), F.col("aid")).select("session", "aid")


def training_keys(candidates: DataFrame, labels: DataFrame, type_: str, seed: int = 0) -> DataFrame:
    """(session, aid) of the positives and sampled negatives of one objective."""
    joined = join_labels(candidates.select("session", "aid"), labels)
    targets = target_sessions(joined, type_)
    rows = positive_list(joined, targets, type_).unionByName(negative_list(joined, targets, type_, seed=seed))
    return rows.distinct()


def training_set(features: DataFrame, labels: DataFrame, type_: str, seed: int = 0) -> DataFrame:
    return features.join(training_keys(features, labels, type_, seed), ["session", "aid"])


def global_negative_sample(
    labeled: DataFrame, per_positive: int = DEFAULTS.global_negatives_per_positive, seed: int = 0
) -> DataFrame:
    """All positives and exactly ``per_positive`` times as many negatives drawn from the whole table."""
    slot = stable_hash(F.col("session"), F.col("aid"), seed=seed)
    limit = F.lit(per_positive) * count_when(F.col("gt") == 1)
    order = [F.asc("session"), F.asc("aid")]
    negatives = smallest(labeled, slot, order, limit, counted=F.col("gt") == 0)
    return labeled.filter(F.col("gt") == 1).unionByName(negatives)


def class_balance(labeled: DataFrame) -> DataFrame:
    return labeled.groupBy("gt").agg(F.count(F.lit(1)).alias("size"))


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` distinct keys (all, if fewer) in seeded hash order."""
    keys = df.select(key).distinct()
    return smallest(keys, stable_hash(F.col(key), seed=seed), [F.asc(key)], n)


def session_sample(events: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """All rows of ``n`` randomly drawn sessions."""
    return events.join(sample_keys(events, "session", n, seed), "session", "left_semi")


def folds(df: DataFrame, n: int = DEFAULTS.folds, seed: int = 0) -> DataFrame:
    """Fold number of every row: sessions, longest first, are dealt round the folds, so that these hold
    about as many rows each; sessions of one length are dealt in random (hash) order.
    """
    order = [F.desc("session_length"), stable_hash(F.col("session"), seed=seed), F.col("session")]
    dealt = global_index(group_sizes(df), *order, out="_place")
    return df.join(dealt.select("session", (F.col("_place") % n).cast("long").alias("fold")), "session")


def group_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("session").agg(F.count(F.lit(1)).alias("session_length"))


def pair_holdout(events: DataFrame, n: int) -> DataFrame:
    """Next-item pairs with valid = 1 for exactly ``n`` of them, held out by session hash and place."""
    pairs = next_item_pairs(events)
    slot = stable_hash(F.col("session"), F.col("pos"))
    held = smallest(pairs, slot, [F.asc("session"), F.asc("pos")], n).select(
        "session", "pos", F.lit(1).alias("valid")
    )
    marked = pairs.join(held, ["session", "pos"], "left")
    return marked.withColumn("valid", F.coalesce("valid", F.lit(0)).cast("long"))


def pair_negatives(pairs: DataFrame, batch_size: int = 65_536, seed: int = 0) -> DataFrame:
    """Every pair with a wrong successor: the one of the next pair of its random batch (cyclic).

    Batches are drawn on the place of a pair, not on its items, so frequent pairs spread over all of
    them and no batch grows with the data.
    """
    h = stable_hash(F.col("session"), F.col("pos"), seed=seed)
    batch = W.partitionBy("batch").orderBy(h, F.col("session"), F.col("pos"))
    whole = batch.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    wrong = F.coalesce(F.lead("aid_next").over(batch), F.first("aid_next").over(whole))
    order = [h, F.col("session"), F.col("pos")]
    return hash_batches(pairs, order, batch_size).withColumn("aid_wrong", wrong).drop("batch")


def kcore_round(events: DataFrame, min_session: int = 5, min_item: int = 5) -> DataFrame:
    """One pass: rows of sessions and items that both have enough rows in the input."""
    sessions = events.groupBy("session").count().filter(F.col("count") >= min_session)
    items = events.groupBy("aid").count().filter(F.col("count") >= min_item)
    return events.join(sessions, "session", "left_semi").join(items, "aid", "left_semi")


def kcore(events: DataFrame, min_session: int = 5, min_item: int = 5, log: list | None = None) -> DataFrame:
    """Rows of sessions and items that keep enough rows when all others are dropped, and theirs, and so on.

    Peeling: the log is folded into (session, item, n) once. What falls below its minimum is the frontier; its pairs lower the
    counts of the other side, and only counts that were lowered can make the next frontier. The log itself is read
    again at the end only. ``log`` gets the pairs that each pass took away. Rows without a session or item are dropped.
    """
    events = events.where(F.col("session").isNotNull() & F.col("aid").isNotNull())
    pairs = staged(events.groupBy("session", "aid").agg(F.count(F.lit(1)).alias("n")))
    least, sides = {"session": min_session, "aid": min_item}, (("session", "aid"), ("aid", "session"))
    degree = {k: staged(pairs.groupBy(k).agg(F.sum("n").alias("all"))) for k in least}
    new = {k: staged(degree[k].where(F.col("all") < least[k]).select(k)) for k in least}
    gone, lost, made = {k: new[k].limit(0) for k in least}, {k: None for k in least}, [pairs, *degree.values()]
    while not all(frontier.isEmpty() for frontier in new.values()):
        taken = {}
        for k, other in sides:  # pairs of the frontier whose other end is still there, and stays for now
            cut = pairs.join(new[k], k, "left_semi").join(gone[other], other, "left_anti").join(new[other], other, "left_anti")
            taken[other] = staged(cut.groupBy(other).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs")))
        if log is not None:
            log.append(sum(t.agg(F.sum("pairs")).first()[0] or 0 for t in taken.values()))
        made += [*taken.values(), *new.values()]
        for k in least:
            gone[k] = gone[k].union(new[k])
            total = taken[k].select(k, "n") if lost[k] is None else lost[k].union(taken[k].select(k, "n")).groupBy(k).agg(F.sum("n").alias("n"))
            lost[k] = staged(total)
            made.append(lost[k])
            touched = lost[k].join(taken[k].select(k), k, "left_semi").join(degree[k], k)
            new[k] = staged(touched.where(F.col("all") - F.col("n") < least[k]).select(k))
    removed = {k: staged(gone[k]) for k in least}
    drop_staged(*made, *new.values())
    return events.join(removed["session"], "session", "left_anti").join(removed["aid"], "aid", "left_anti").select(events.columns)


def ratio_split(events: DataFrame, parts: tuple[int, ...] = (9, 1, 0)) -> DataFrame:
    """Per-session split in time order: ``part`` 0, 1, ... with shares as in ``parts``.

    Later parts get floor(length * share) rows, or one row if their share is below one row and the
    first part still has more than one. The first part gets the rest.
    """
    total = sum(parts)
    length, back = F.col("length"), F.col("pos_from_end")
    sizes = {i: F.floor(length * parts[i] / F.lit(total)).cast("long") for i in range(1, len(parts))}
    rest = length - sum(sizes.values(), F.lit(0))
    for i in sorted(sizes, reverse=True):
        small = F.lit(parts[i] > 0) & (length * parts[i] < total) & (rest > 1)
        extra = F.when(small, 1).otherwise(0)
        sizes[i], rest = sizes[i] + extra, rest - extra
    part, taken = F.lit(0), F.lit(0)
    for i in sorted(sizes, reverse=True):
        part = F.when((back >= taken) & (back < taken + sizes[i]), F.lit(i)).otherwise(part)
        taken = taken + sizes[i]
    return with_positions(events).select("session", "aid", "ts", "type", part.cast("long").alias("part"))


def shuffled_rows(df: DataFrame, *ids: str, seed: int = 0) -> DataFrame:
    """The rows in seeded random order, numbered from 0 in ``place``; ``ids`` should name a row."""
    return global_index(df, stable_hash(*[F.col(c) for c in ids], seed=seed), *[F.col(c) for c in ids], out="place")


def interaction_matrix(events: DataFrame) -> DataFrame:
    return events.groupBy("session", "aid").agg(F.count(F.lit(1)).alias("n"))

