"""Scalar expressions over interaction columns. All of them stay in codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionlens.config import DAY_MS, HOUR_MS, RECENCY_TYPE_WEIGHT, TYPE_CODE

HASH_BITS = 60


def seconds(ts_ms: Column) -> Column:
    return F.floor(ts_ms / F.lit(1000)).cast("long")


def event_time(ts_ms: Column) -> Column:
    """Wall clock time in UTC, independent of the session time zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=(ts_ms.cast("decimal(20,0)") / F.lit(1000)).cast("decimal(18,6)")
    )


def nanoseconds(ts_s: Column) -> Column:
    return ts_s.cast("double") * F.lit(1e9).cast("double")


def local_day(ts_ms: Column, offset_hours: int) -> Column:
    """Calendar date at UTC+offset, independent of the session time zone."""
    days = F.floor((ts_ms + F.lit(offset_hours * HOUR_MS)) / F.lit(DAY_MS)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def _lookup(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def type_code(type_col: Column) -> Column:
    return _lookup(type_col, TYPE_CODE).cast("long")


def type_weight(type_col: Column, table: dict[str, float]) -> Column:
    return _lookup(type_col, {t: float(w) for t, w in table.items()})


def count_when(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def _recency_step(length: Column) -> Column:
    return F.lit(0.9).cast("double") / F.nullif(length - 1, F.lit(0)).cast("double")


def log_recency(pos_from_end: Column, length: Column) -> Column:
    """1 for the newest event, falling to 2^0.1 - 1 for the oldest."""
    power = F.lit(0.1).cast("double") + _recency_step(length) * (length - pos_from_end - 1)
    return F.when(length == 1, F.lit(1.0).cast("double")).otherwise(
        F.pow(F.lit(2.0).cast("double"), power) - 1
    )


def log_recency_sum(oldest: Column, n: Column, length: Column) -> Column:
    """Sum of the scores of ``n`` neighbouring events, from the score of the oldest of them.

    score + 1 grows by a constant factor from event to event: a geometric series.
    """
    growth = _recency_step(length) * F.lit(math.log(2.0))
    series = (oldest + 1) * F.expm1(growth * n) / F.expm1(growth) - n
    return F.when(n == 1, oldest).otherwise(series)


def weighted_recency(type_col: Column, recency: Column) -> Column:
    return type_weight(type_col, RECENCY_TYPE_WEIGHT) * recency


def stable_hash(*ids: Column, seed: int = 0) -> Column:
    """Repeatable pseudo-random number of HASH_BITS bits, from the md5 of the seed and the ids as text.

    Any SQL engine gives the same, and two seeds have nothing to do with each other.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(x.cast("string"), F.lit("")) for x in ids])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def round6(value: Column) -> Column:
    return F.round(value.cast("double"), 6)
