from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sessionlens.llm import common

from .brute import words


def test_word_hashes_agree_with_words():
    texts = ["A b  a\tB\x0bc", None, "", " \n", "x" * 2_500_000 + " y " * 3, "é É z é"]
    got = common.word_hashes(pa.array(texts, pa.string()))
    names = {}
    for text, hashes in zip(texts, got):
        assert len(words(text)) == len(hashes)
        for w, h in zip(words(text), hashes.tolist()):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    assert common.word_hashes(pa.array([], pa.string())) == []
    part = common.word_hashes(pa.array(["zz a", "b a", "a"], pa.string()).slice(1))
    assert part[0][1] == part[1][0] and len(part) == 2


def test_shingles_of_short_texts():
    w = np.arange(1, 8, dtype=np.uint64)
    assert [len(common.shingle_hashes(w[:n])) for n in range(8)] == [0, 1, 1, 1, 1, 1, 2, 3]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    links += [(2000, 2000 + i) for i in range(1, 200)] + [(None, 5), (7, 7)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clashing_columns_survive(spark):
    docs = spark.createDataFrame([(1, "a", 2, 3)], "doc_id long, text string, key long, row long")
    rows = common.keyed(docs, "text", "doc_id")
    assert common.unpacked(rows).collect() == docs.collect()
    assert common.unpacked(rows, text=F.lit("b"), new=F.lit(1)).columns == ["doc_id", "text", "key", "row", "new"]


def test_runs_of_equal_keys_cross_batches():
    batches = [pa.RecordBatch.from_pydict({"a": [1, 1, 2], "b": [0, 0, 0]}), pa.RecordBatch.from_pydict({"a": [2, 2], "b": [0, 1]})]
    assert [g.num_rows for g in common.groups(iter(batches), ["a", "b"])] == [2, 2, 1]
    assert list(common.groups(iter([]), ["a"])) == []
