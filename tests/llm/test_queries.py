"""The queries with SQL, side by side on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

from sessionlens.llm.queries import ORACLES, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
import check  # noqa: E402

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in check.TABLES.split():
        duck.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    verdict = check.compare(spark, duck, name, QUERIES[name], ORACLES[name], SF)
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("n", range(1, 14))
def test_every_operator_has_its_query(n):
    assert sum(name.startswith(f"op{n}_") for name in QUERIES) == 1


def test_language_of_pages(spark):
    rows = QUERIES["page_languages"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r["language"] and r["probability"] > 0.5 for r in rows)
