from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

from sessionlens.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_additive_model_learns_shapes_and_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((6000, 4))
    truth = (np.abs(x[:, 0] - 0.5) > 0.25) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))
    model = Q.fit_additive(x[:4000], truth[:4000].astype(float), rng.random(4000) < 0.2)
    assert ((model.score(x[4000:]) > 0.5) == truth[4000:]).mean() > 0.9
    assert len(model.pairs) == Q.PAIRS
    one = model.margin(x[:1])[0]  # a score is a sum of looked-up values
    fine, coarse = model.bins(x[:1])[0], model.bins(x[:1], True)[0]
    parts = [t[b] for t, b in zip(model.tables, fine)] + [t[coarse[j], coarse[k]] for (j, k), t in zip(model.pairs, model.pair_tables)]
    assert one == pytest.approx(model.intercept + sum(parts))


def test_constant_without_both_labels():
    x = np.random.default_rng(0).random((50, 3))
    assert np.allclose(Q.fit_additive(x, np.ones(50), np.zeros(50, bool)).score(x), 51 / 52)
    assert np.allclose(Q.fit_additive(x[:0], np.ones(0), np.zeros(0, bool)).score(x), 0.5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.quality_scores(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.9


def test_edge_cases(spark):
    rows = [(1, "good plain words here", 0), (1, "good plain words here", 0), (None, "x y", 0), (2, None, 0), (3, "", 0), (4, " \n", 0), (5, "THE!! " * 100_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (5, 7), (None, 1)], "doc_id long, quality int")
    got = Q.quality_scores(docs, labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and got.score.notna().all()
    assert got[got.doc_id == 1].score.nunique() == 1 and not got[got.doc_id.isna()].held_out.any()
    assert Q.quality_scores(docs, labels.limit(0)).count() == len(rows)
    assert Q.quality_scores(docs.limit(0), labels).count() == 0
