from __future__ import annotations

import random

import numpy as np
import pytest

from sessionlens.llm import jaccard_join as J

from .brute import component_ids


def corpus(seed=1, n=120):
    """Texts with exact copies, near copies of growing distance, common passages and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    out = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 30, 60, 90]))]
        if rng.random() < 0.3:
            w += passage
        out.append(w)
        for k in range(rng.choice([0, 0, 0, 1, 3, 6])):
            copy = list(w)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(copy[: len(copy) - rng.choice([0, 0, 2])] or copy)
    base = [rng.choice(vocabulary) for _ in range(80)]
    for k in range(60):  # a large group of near copies
        copy = list(base)
        copy[rng.randrange(80)] = f"x{k}"
        out.append(copy)
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def check(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(docs).collect()}
    assert got == dict(zip([i for i, _ in rows], component_ids(rows)))


def test_random_corpora_agree_with_brute_force(spark):
    check(spark, corpus(1))


def test_trees_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 4)
    check(spark, corpus(2))


def test_edge_cases(spark):
    long = " ".join(f"t{i % 977} u{i}" for i in range(20_000))
    rows = [
        (5, "a b c d e f g"), (5, "a b c d e f g"), (3, "A  b\tc d e f\ng"), (None, "a b c d e f g"),
        (9, None), (8, ""), (7, " \n\t"), (6, "one two"), (2, "two one"), (1, "ONE two"), (11, long), (10, long + " tail"), (None, "only null"),
    ]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, n long, cid long")
    got = J.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert len(got) == len(rows)
    ids = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert ids[5, 3] == ids[3, 3] == ids[None, 3] == 3
    assert [ids[i, 0] for i in (9, 8, 7)] == [9, 8, 7]
    assert ids[6, 1] == ids[1, 1] == 1 and ids[2, 1] == 2
    assert {r["component_id"] for r in got if r["doc_id"] in (10, 11)} == {10}
    assert ids[None, 1] is None
    assert J.jaccard_components(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (7, "a b c d e f g"), (None, "a b c d e f g"), (8, ""), (8, ""), (None, "n n n"), (None, "n n n"), (4, "solo text")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    kept = J.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "n n n"), (4, "solo text"), (5, "a b c d e f g"), (8, ""), (8, "")]
    assert J.keep_one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 23, 100, 333])
def test_prefixes_hold_what_linked_sets_share(n):
    """Any two sets that may be linked share enough of their counted shingles, and one of their prefixes."""
    need = J.counted_length(n) - (n - -(-3 * n // 4))
    for m in range(1, 2 * n + 1):
        shared = -(-3 * (n + m) // 7)
        if shared <= min(n, m):
            assert min(J.counted_length(n) - n + shared, J.counted_length(m) - m + shared) >= need
            assert min(J.prefix_length(n) - n + shared, J.prefix_length(m) - m + shared) >= 1


def test_bounds_never_prune_linked_sets():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(5, 80), dtype=np.uint64)
        for _ in range(3):
            keep = base[rng.random(len(base)) > 0.1]
            sets.append(np.unique(np.r_[keep, rng.integers(0, 2**63, 2, dtype=np.uint64)]))
    tree = J._Tree(sets, 256)
    i, j = np.triu_indices(len(sets), 1)
    ok = J.possible(tree.level(0), tree.level(0), i, j)
    assert all(o for o, a, b in zip(ok, i, j) if J.linked(sets[a], sets[b]))
    joined = J._Joined(list(range(len(sets))))
    places = list(range(len(sets)))
    J._descend(tree, tree, sets, places, places, joined)
    whole = J._Joined(list(range(len(sets))))
    for a, b in zip(i.tolist(), j.tolist()):
        if whole.root(a) != whole.root(b) and J.linked(sets[a], sets[b]):
            whole.join(a, b)
    assert joined.roots().tolist() == whole.roots().tolist()
