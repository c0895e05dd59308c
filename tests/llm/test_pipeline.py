from __future__ import annotations

import random

import corpus_pipeline as P
from sessionlens.sources.sinks import staged

from .brute import component_ids, contained, cut_lines, words


def corpus(seed=7):
    rng = random.Random(seed)
    english, german = "the and of to in is that it was for on are with as".split(), "der die und das ist nicht ein mit auf dem den von zu".split()
    word = lambda base: rng.choice(base) if rng.random() < 0.5 else rng.choice(base) + rng.choice(base)
    text = lambda base, n: " ".join(word(base) for _ in range(n))
    passage = "\n".join(text(english, 20) for _ in range(4))
    items = [(i, text(english, 20)) for i in range(3)]
    rows = []
    for i in range(90):
        lang, base = ("en", english) if i % 3 else ("de", german)
        body = "\n".join(text(base, rng.randrange(5, 25)) for _ in range(rng.randrange(1, 5)))
        if i % 10 == 1:
            body += "\n" + passage
        if i % 15 == 2:
            body += " " + items[i % 3][1] + " " + text(base, 3)
        rows.append((i, body, lang, f"s{i % 4}"))
    for i in range(90, 100):  # exact and near copies, the latter in one long line
        rows.append((i, rows[i - 85][1], rows[i - 85][2], "s1"))
    line = text(english, 60).split()
    for i in range(100, 106):
        line[i % 60] = "changed" + str(i)
        rows.append((i, " ".join(line), "en", "s2"))
    rows += [(106, None, "en", "s0"), (107, "", "en", "s0"), (108, "12 !!", "en", None), (109, text(english, 30), None, None)]
    return rows, items


def test_stages_agree_with_brute_force(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, out = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in P.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)))
        out.append({r["doc_id"]: r for r in docs.collect()})
    texts = [{i: r["text"] for i, r in x.items()} for x in out]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(next(iter(x.values())).asDict()) == names for x in out[:4])

    assert set(texts[0]) == {i for i, t, _, _ in rows} - {106, 107, 108}
    cut = cut_lines(list(texts[0].items()))
    assert texts[1] == {i: t for i, t in cut.items() if words(t)}
    assert all(r["n_chars"] == len(r["text"]) for r in out[1].values())
    order = list(texts[1].items())
    assert set(texts[2]) == {i for (i, _), c in zip(order, component_ids(order)) if i == c}
    assert set(texts[3]) == {i for i, t in texts[2].items() if not any(contained(t, q) for _, q in items)}
    assert set(texts[4]) <= set(texts[3]) and len(texts[3]) < len(texts[2]) < len(texts[1])
    total, target = {}, {}
    for i, r in out[4].items():
        assert 1 <= r["copies"] <= 3 and r["taken"] == r["copies"] * len(words(r["text"]))
        total[r["source"]] = total.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    longest = max(len(words(t)) for t in texts[3].values())
    assert all(abs(total[s] - target[s]) <= longest for s in total)
    final = {r["doc_id"]: r["copies"] for r in P.run(spark, str(tmp_path)).collect()}
    assert final == {i: r["copies"] for i, r in out[4].items()}
