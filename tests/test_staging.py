"""Staged tables lie in the shared folder and can be deleted."""

from __future__ import annotations

import os

import pytest

from sessionlens.sources import sinks


class _Context:
    def __init__(self, master):
        self.master, self.applicationId = master, "app-1"


class _Session:
    """Just what the choice of the folder looks at."""

    def __init__(self, master, named=None):
        self.sparkContext, self.named = _Context(master), named
        self.conf = self

    def get(self, key, default):
        return self.named or default

    def set(self, key, value):
        self.named = value


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            sinks.shared_folder(_Session(master))
    assert sinks.shared_folder(_Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert sinks.shared_folder(_Session("local[8]")).startswith("file:///")


def test_nothing_is_left_after_a_scope(spark):
    with sinks.staging_scope(spark):
        table = sinks.staged(spark.range(10))
        folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert table.count() == 10 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_one_table_is_dropped(spark):
    one, two = sinks.staged(spark.range(3)), sinks.staged(spark.range(4))
    sinks.drop_staged(one)
    assert two.count() == 4


def test_scope_that_keeps_its_result(spark):
    earlier = sinks.staged(spark.range(3))
    with sinks.only_kept(spark) as keep:
        between = sinks.staged(spark.range(5))
        result = sinks.staged(between.selectExpr("id + 1 as id"))
        keep.append(result)
    assert result.count() == 5 and earlier.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(between.inputFiles()[0])
    sinks.drop_staged(result, earlier)
