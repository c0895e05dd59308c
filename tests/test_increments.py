"""Day-by-day co-visitation against one pass over the whole log."""

from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from sessionlens.config import COVISIT
from sessionlens.operators import increments as I
from sessionlens.operators.covisit import covisit, edge_counts

DAY = 86_400_000


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("mode, tail", [("clicks", 5), ("buy2buy", 4), ("clicks", 30)])
def test_equal_to_one_pass(spark, events, tmp_path, mode, tail):
    spec, path = dataclasses.replace(COVISIT[mode], tail=tail), str(tmp_path / "state")
    dated = events.withColumn("day", F.floor(F.col("ts") / DAY)).cache()
    days = sorted(r["day"] for r in dated.select("day").distinct().collect())
    for day in days:
        I.add_day(path, day, dated.where(F.col("day") == day), spec)
    assert rows(I.counted(spark, path)) == rows(edge_counts(events, spec))
    last = dated.where(F.col("day") == days[-1])
    I.add_day(path, days[-1], last, spec)  # run again
    assert rows(I.counted(spark, path)) == rows(edge_counts(events, spec))
    span = events.agg(F.min(F.floor(F.col("ts") / 1000)), F.max(F.floor(F.col("ts") / 1000))).first()
    assert rows(I.covisit_kept(spark, path, spec, tuple(span))) == rows(covisit(events, spec=spec))


def test_only_touched_sessions_are_read(spark, events, tmp_path):
    spec, path = COVISIT["clicks"], str(tmp_path / "state")
    I.add_day(path, 0, events, spec)
    some = events.where("session = 5").limit(3).withColumn("ts", F.col("ts") + 90 * DAY)
    read = I.add_day(path, 1, some, spec)
    assert 0 < read <= spec.tail
    assert rows(I.counted(spark, path)) == rows(edge_counts(events.unionByName(some), spec))
    assert I.add_day(path, 2, events.limit(0), spec) == 0
