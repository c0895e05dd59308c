from __future__ import annotations

import random

from sessionlens.llm.line_dedup import line_dedup

from .brute import cut_lines


def corpus(seed, n=60):
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(k))
    passages = [[line(rng.choice([1, 4, 12, 20, 55])) for _ in range(rng.choice([1, 2, 4, 7]))] for _ in range(8)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.choice([0, 1, 2, 4])):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            out += [line(rng.choice([1, 3, 9]))] * rng.choice([0, 1]) + p[a : a + rng.choice([1, 3, 9])] + [""] * rng.choice([0, 0, 1])
        rows.append((i, "\n".join(out)))
    rows.append((n, "\n".join(["tick tock"] * 60)))  # repeats itself
    return rows


def test_agrees_with_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r["text"] for r in line_dedup(docs).collect()}
        want = cut_lines(rows)
        assert got == want
        assert sum(got[i] != t for i, t in rows) > 5


def test_edge_cases(spark):
    run = "\n".join(f"line {i} of a run that comes again and again" for i in range(8))
    rows = [
        (1, "head\n" + run, 1), (2, run + "  \n tail", 1), (2, run + "  \n tail", 1), (None, "x\n" + run, 1), (None, None, 1), (3, None, 1), (4, "", 1), (5, "\n \n", 1),
        (6, "short\nlines\nshort\nlines", 1), (7, " ".join("w" for _ in range(100_000)), 1), (8, run.replace("\n", "\n\n"), 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut long")
    out = line_dedup(docs, report=True).collect()
    assert len(out) == len(rows) and all(r["cut"] == 1 for r in out)
    got = [(r["doc_id"], r["text"], r["lines_cut"]) for r in out]
    assert (1, "head\n" + run, 0) in got  # the first copy
    assert got.count((2, " tail", 8)) == 2  # repeated rows are one document
    assert (None, "x", 8) in got and (None, None, 0) in got and (3, None, 0) in got  # null ids come last
    assert (4, "", 0) in got and (5, "\n \n", 0) in got and (6, "short\nlines\nshort\nlines", 0) in got
    assert (8, "", 8) in got  # blank lines inside a run go with it
    assert {r["words_cut"] for r in out if r["lines_cut"]} == {80}
    assert line_dedup(docs).columns == docs.columns
    assert line_dedup(docs.limit(0), report=True).count() == 0
