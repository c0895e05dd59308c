"""Expressions over bounded array columns (top-k lists, padded sequences)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def newest_first_unique(items: Column) -> Column:
    """Each item once, the latest occurrence first."""
    return F.array_distinct(F.reverse(items))


def first_k(items: Column, k: int) -> Column:
    return F.slice(items, 1, k)


def last_k(items: Column, k: int) -> Column:
    return F.when(F.size(items) > k, F.slice(items, -k, k)).otherwise(items)


def pad_right(items: Column, length: int, value: int = 0) -> Column:
    padding = F.array_repeat(F.lit(value).cast("long"), F.greatest(F.lit(0), length - F.size(items)))
    return F.concat(items, padding)


def join_text(items: Column, separator: str = " ") -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), separator)


def overlap(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right)).cast("long")


def ordered_list(order: Column, value: Column) -> Column:
    """Aggregate: values sorted by ``order``. Only for groups of bounded size."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])
