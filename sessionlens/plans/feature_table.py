"""The feature table of all candidates."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame

from sessionlens.config import DEFAULTS, Settings
from sessionlens.operators import features as X
from sessionlens.operators.candidates import popular_candidates, popular_items
from sessionlens.sources.sinks import staged, staged_together


class Stats:
    """Aggregates of one event log.

    The event scan behind them runs once: the per-day base and the item table, which several
    results read, are staged in shared storage when first asked for.
    """

    def __init__(self, events: DataFrame, settings: Settings = DEFAULTS):
        self.events = events
        self.settings = settings

    @cached_property
    def base(self) -> DataFrame:
        return staged(X.item_days(self.events, self.settings))

    @cached_property
    def totals(self) -> DataFrame:
        return X.session_item_totals(self.base, self.settings)

    @cached_property
    def sessions(self) -> DataFrame:
        return X.session_stats(self.totals, self.settings)

    @cached_property
    def items(self) -> DataFrame:
        return staged(X.item_stats(self.base, self.totals, self.settings))

    @cached_property
    def popular(self) -> DataFrame:
        return popular_candidates(self.base, popular_items(self.base, self.settings))

    @cached_property
    def history(self) -> DataFrame:
        return X.session_item_stats(self.events, self.settings)


def candidate_keys(stats: Stats, sources: list[DataFrame]) -> DataFrame:
    """(session, aid) of every candidate: ranked, popular or already in the history."""
    rows = [*sources, stats.popular, stats.base]
    return reduce(DataFrame.unionByName, [r.select("session", "aid") for r in rows]).distinct()


def candidate_union(stats: Stats, sources: list[DataFrame]) -> DataFrame:
    merged = X.merge_candidates(sources, stats.popular, stats.settings)
    return X.candidate_union(stats.history, merged)


def together(sources: list[DataFrame]) -> list[DataFrame]:
    """The same rows as one staged table, for when the keys are needed before the features."""
    return [staged(reduce(DataFrame.unionByName, sources))]


def candidate_features(stats: Stats, sources: list[DataFrame], keys: DataFrame | None = None) -> DataFrame:
    """Columns keyed by (session, aid): candidates of all sources, popular items and history.

    With ``keys`` only those rows are worked out, not all and then cut.
    """
    popular, history = stats.popular, stats.history
    if keys is not None:
        pair = ["session", "aid"]
        sources = [s.join(keys, pair, "left_semi") for s in sources]
        popular, history = popular.join(keys, pair, "left_semi"), history.join(keys, pair, "left_semi")
    merged, history, sessions = staged_together(
        X.merge_candidates(sources, popular, stats.settings), history, stats.sessions
    )
    union = X.candidate_union(history, merged)
    return X.candidate_features(union, sessions, stats.items, stats.settings)
