"""Candidate jobs: from event logs to ranked candidate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sessionlens.operators import candidates as G
from sessionlens.operators.covisit import covisit, covisit_by_day
from sessionlens.operators.neighbours import item_knn_cells
from sessionlens.sources.sinks import staged_together


def covisit_candidates(train: DataFrame, test: DataFrame, span: tuple[int, int] | None = None) -> DataFrame:
    """Three co-visitation matrices and the votes on them (session, type, aid, rank)."""
    clicks, buys = covisit_by_day(train, span)
    return G.candidates_by_type(G.suggest_clicks(test, clicks), G.suggest_buys(test, buys, covisit(train, "buy2buy")))


def vector_neighbours(test: DataFrame, vectors: DataFrame) -> DataFrame:
    """Embedding neighbours of the items that occur in the test sessions."""
    return item_knn_cells(vectors, test.select("aid"))


def sequence_job(train: DataFrame, test: DataFrame) -> DataFrame:
    return G.sequence_candidates(test, G.transitions(train))


def candidate_sources(train: DataFrame, test: DataFrame, vectors: DataFrame) -> list[DataFrame]:
    """All generators at once as rows (session, aid, slot, rank).

    Slots are named after what fills them. Tables of other models go in through ``read_candidates`` and
    ``tall_source`` under a slot of their own (``Settings.slots``). The item models are independent of each
    other and staged side by side.
    """
    clicks, buys, bought, near, model = staged_together(
        *covisit_by_day(train),
        covisit(train, "buy2buy"),
        vector_neighbours(test, vectors),
        G.transitions(train),
    )
    by_clicks = G.suggest_clicks(test, clicks)
    typed = G.candidates_by_type(by_clicks, G.suggest_buys(test, buys, bought))
    return [
        G.tall_covisit(typed),
        G.tall_source(G.suggest_clicks(test, near), "vector_vote"),
        G.tall_source(G.sequence_candidates(test, model), "transition"),
        G.tall_source(G.last_item_candidates(test, near), "last_item"),
    ]
