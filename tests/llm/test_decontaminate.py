from __future__ import annotations

import random

from sessionlens.llm import decontaminate as D

from .brute import contained, words


def tables(spark, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice([1, 2, 4, 5, 6, 20, 60]))) for i in range(40)]
    docs = []
    for i in range(150):
        w = text(rng.choice([0, 3, 50, 2000]))
        if rng.random() < 0.5:
            part = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 3])):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = part[rng.choice([0, 0, 1, 5]) :]
        docs.append((i, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)))
    return docs, [(i, " ".join(w)) for i, w in items]


def test_agrees_with_brute_force(spark, monkeypatch):
    docs, items = tables(spark)
    want = {(i, k) for i, t in docs for k, q in items if contained(t, q)}
    assert len(want) > 40
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda **more: {(r["doc_id"], r["item_id"]) for r in D.contained_items(df, bench, **more).collect()}
    assert found(least_words=1) == want
    long = {(i, k) for i, k in want if len(words(dict(items)[k])) >= 5}
    assert found() == long != want
    monkeypatch.setattr(D, "BLOCK_WORDS", 100)  # several blocks
    assert found(least_words=1) == want
    kept = D.decontaminate(df, bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in long}
    short = {r["item_id"] for r in D.short_items(bench).collect()}
    assert short == {k for k, q in items if len(words(q)) < 5}


def test_a_corpus_survives_a_short_item(spark):
    """Items of one to four words stand in any text; code and SQL pass them over alike."""
    import duckdb

    from sessionlens.llm.queries import ORACLES

    docs = [(1, "the cat sat on the mat"), (2, "a b c d e f g"), (3, "the"), (4, "a b c d")]
    items = [(1, "the"), (2, "a b c d"), (3, "b c d e f"), (4, None), (5, "the cat")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["item_shingles"], r["shared"]) for r in D.contained_items(df, bench).collect()}
    duck = duckdb.connect()
    for name, rows in (("documents", docs), ("benchmark", items)):
        duck.execute(f"create table {name} ({'doc_id' if name == 'documents' else 'item_id'} bigint, text varchar)")
        duck.executemany(f"insert into {name} values (?, ?)", rows)
    assert got == set(duck.execute(ORACLES["op1_decontaminate"]).fetchall()) == {(2, 3, 1, 1)}
    assert {r["doc_id"] for r in D.decontaminate(df, bench).collect()} == {1, 3, 4}


def test_edge_cases(spark):
    item = "one two three four five six seven"
    docs = [(1, f"x {item} y"), (1, f"x {item} y"), (None, item), (2, None), (3, ""), (4, " \t"), (5, "seven six five"), (6, "z " * 300_000 + item)]
    df = spark.createDataFrame([(i, t, 9, 9) for i, t in docs], "doc_id long, text string, key long, row long")
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None), (9, "")], "item_id long, text string")
    found = sorted(((r["doc_id"] or 0, r["item_id"] or 0) for r in D.contained_items(df, bench).collect()))
    assert found == sorted([(1, 7), (1, 0)] * 2 + [(0, 7), (0, 0), (6, 7), (6, 0)])
    kept = D.decontaminate(df, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5] and kept.columns == df.columns
    assert D.contained_items(df.limit(0), bench).count() == 0
    assert D.decontaminate(df, bench.limit(0)).count() == len(docs)
