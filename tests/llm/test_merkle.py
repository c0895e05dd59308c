from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sessionlens.llm import merkle as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests):
    """Root and, for each digest, its (left, right) siblings level by level."""
    steps, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, i in enumerate(at):
            run, pos = runs[i // 8], i % 8
            steps[k].append(("".join(run[:pos]), "".join(run[pos + 1 :])))
        at, level = [i // 8 for i in at], [sha("".join(r)) for r in runs]
    return level[0], steps


def manifest(rows):
    """{leaf: [(doc_id, group, subroot, root, steps)]} of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, over = climb([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, over):
        for x, steps in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            out.append((x[2], x[3], g, trees[g][0], root, steps + up))
    return out


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    text = lambda c: M.hex_text(F.col(c)).alias(c)
    steps = F.transform("steps", lambda s: F.struct(M.hex_text(s["left"]).alias("l"), M.hex_text(s["right"]).alias("r"))).alias("steps")
    got = M.merkle_proofs(docs.repartition(3), **more).withColumn("folded", M.fold(F.col("claim"), F.col("steps")) == F.col("root"))
    return [(r["leaf"], r["doc_id"], r["group"], r["subroot"], r["root"], [tuple(s) for s in r["steps"]], r["folded"]) for r in got.select(text("leaf"), "doc_id", "group", text("subroot"), text("root"), steps, "folded").collect()]


def corpus(n, langs, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice(["s", None, ""]), rng.choice(langs), rng.choice([None, i]), " ".join(rng.choices("abcé\U0001f600", k=rng.randrange(9)))) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("n, langs, lane", [(700, ["a", None, "é", ""], 9), (900, ["a", "a", "a", "b"], 1), (9, ["x"], 9), (40, [f"l{i}" for i in range(30)], 2)])
def test_equal_to_brute_force(spark, monkeypatch, n, langs, lane):
    monkeypatch.setattr(M, "LANE_BITS", lane)
    rows = corpus(n, langs)
    assert sorted(found(spark, rows), key=repr) == sorted([(*x, True) for x in manifest(rows)], key=repr)


def test_edge_cases(spark):
    long = "word " * 200_000
    rows = [(None, None, None, None, None), (None, "a", None, 1, ""), (1, "s", "en", 0, ""), (1, "s", "en", 0, None), (2, "s", "en", 5, long)] + [(3, "s", "en", 1, "Same")] * 20
    assert sorted(found(spark, rows), key=repr) == sorted([(*x, True) for x in manifest(rows)], key=repr)
    assert found(spark, rows[:1])[0][3:6] == (leaf(rows[0]), leaf(rows[0]), [])
    assert found(spark, []) == []


def test_other_columns_are_not_looked_at(spark):
    rows = corpus(50, ["a", "b"])
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    clash = docs
    for c in ("tree", "idx", "n", "id", "grp", "tie", "leaf", "claim", "steps", "root", "kids", "digest"):
        clash = clash.withColumn(c, F.lit("x"))
    key = lambda d: sorted(map(repr, M.merkle_proofs(d).collect()))
    assert key(clash) == key(docs)


def test_changed_rows_fail(spark):
    rows = [(i, "s", "en", 4, f"Text {i}") for i in range(100)]
    claim = M.leaf_digest(*[F.when(F.col("doc_id") % 5 == 0, F.lower("text")).otherwise(F.col("text")) if f == "text" else F.col(f) for f in M.FIELDS])
    assert all(x[6] == (x[1] % 5 != 0) for x in found(spark, rows, claim=claim))
