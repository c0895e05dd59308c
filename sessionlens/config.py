"""Settings and fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS

# They must equal the published ones for equal results.
TYPES = ("clicks", "carts", "orders")
TYPE_CODE = {"clicks": 0, "carts": 1, "orders": 2}
OBJECTIVE_WEIGHT = {"clicks": 0.10, "carts": 0.30, "orders": 0.60}
RECENCY_TYPE_WEIGHT = {"clicks": 1.0, "carts": 6.0, "orders": 3.0}
COVISIT_TYPE_WEIGHT = {
    "clicks": 0.07197733833680556,
    "carts": 0.708280136807459,
    "orders": 0.05318170583899917,
}
CANDIDATE_SLOTS = (
    "covisit_clicks",
    "covisit_carts",
    "covisit_orders",
    "vector_vote",
    "transition",
    "last_item",
)
UNRANKED = 1_000_000


@dataclass(frozen=True)
class CovisitSpec:
    """One item-item matrix: which rows pair up and what a pair weighs."""

    window_ms: int
    weighting: str  # "recency" | "type" | "unit"
    types: tuple[str, ...] = TYPES
    tail: int = 30
    top_n: int = 15


COVISIT = {
    "clicks": CovisitSpec(DAY_MS, "recency"),
    "carts_orders": CovisitSpec(DAY_MS, "type"),
    "buy2buy": CovisitSpec(14 * DAY_MS, "unit", types=("carts", "orders")),
}


@dataclass(frozen=True)
class Settings:
    day_offset_hours: int = 2
    n_days: int = 7
    candidates: int = 100
    last_item_candidates: int = 20
    neighbours: int = 20
    history_tail: int = 20
    submit_k: int = 20
    popular_rank: int = 20
    negatives_per_positive: int = 20
    global_negatives_per_positive: int = 80
    folds: int = 5
    slots: tuple[str, ...] = field(default=CANDIDATE_SLOTS)


DEFAULTS = Settings()
