from __future__ import annotations

import hashlib
import os
from collections import Counter

import numpy as np
import pytest

from sessionlens.llm import alignment as A

pytestmark = pytest.mark.skipif(not os.path.exists(A.BYTE_LEVEL), reason="no tokenizers")

TEXTS = [
    "Hello world, the tokenizers disagree  here.\n\nNext paragraph: 12345 + 67890 = ?",
    "Grüße aus München — naïve café \U0001f600\U0001f601", None, "", " ", "   leading and trailing   ", "tab\tand nbsp",
    "piece mark ▁ inside", "<|endoftext|> and <s> </s> <unk> <0x41>", "ﬁ ligature and Å", "a", "\n", "日本語のテキスト と 한국어", "zero\u0000byte",
    "the cat sat on the mat. " * 400, "unbrokenstring" * 300, "=" * 700, "Hello world, the tokenizers disagree  here.",
]


@pytest.fixture(scope="module")
def tokenizers():
    return A.ByteLevel(open(A.BYTE_LEVEL, "rb").read()), A.Pieces(open(A.PIECES, "rb").read())


def spans(tokenizer, text):
    out, at = [], 0
    for i in tokenizer.encode([text])[0]:
        out.append((i, at, at + len(tokenizer.bytes[i])))
        at = out[-1][2]
    whole = b"".join(tokenizer.bytes[i] for i, _, _ in out)
    return out if whole == b" " + text.encode() else None


def plain(tokenizers, texts):
    """Per text: tokens, groups as lists of ids, overlaps; or None."""
    out = []
    for text in texts:
        a, b = (spans(t, text) if text else None for t in tokenizers)
        if not a or not b:
            out.append(None)
            continue
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = [([i for i, _, e in a if s < e <= t], [i for i, _, e in b if s < e <= t]) for s, t in zip([0, *ends], ends)]
        out.append((a, b, groups, sum(max(x[1], y[1]) < min(x[2], y[2]) for x in a for y in b)))
    return out


def expected(tokenizers, rows):
    found = plain(tokenizers, [t for _, t in rows])
    links = [Counter((x, y) for ga, gb in f[2] for x in ga for y in gb) if f else Counter() for f in found]
    count = Counter(p for own in links for p in own)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (doc_id, _), f, own in zip(rows, found, links):
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in f[2]) if f else ""
        sizes = (len(f[0]), len(f[1]), len(f[2]), f[3], sum(own.values())) if f else (0,) * 5
        out.append((doc_id, *sizes, hashlib.sha256(said.encode()).hexdigest() if f else "", sum(m for p, m in own.items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in own.items())))
    return out


@pytest.mark.parametrize("frequent", [1 << 19, 40, 0])
def test_equal_to_brute_force(spark, tokenizers, monkeypatch, frequent):
    monkeypatch.setattr(A, "FREQUENT", frequent)
    rows = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (0, TEXTS[0])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, a long, no string").repartition(3)
    aligned = A.staged(A.align_tokens(docs))
    got = A.alignment_scores(aligned, A.pair_counts(aligned)).select("doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_links", "groups", "n_best", "count_sum")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected(tokenizers, rows)))


def test_cases_that_have_no_tokens(spark, tokenizers):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "piece mark ▁ inside")], "doc_id long, text string")
    for r in A.align_tokens(docs).collect():
        assert tuple(r)[1:] == (0, 0, 0, 0, 0, "", [], [], [])
    empty = A.align_tokens(docs.limit(0))
    assert A.alignment_scores(empty, A.pair_counts(A.staged(empty))).count() == 0


def test_groups_as_text_and_pairs(spark, tokenizers):
    docs = spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")
    r = A.align_tokens(docs, whole=True).first()
    a, b, groups, _ = plain(tokenizers, [TEXTS[0]])[0]
    assert r["groups"] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    want = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
    assert dict(zip(zip(r["a"], r["b"]), r["links"])) == dict(want)


def test_products(monkeypatch):
    rng = np.random.default_rng(1)
    for terms in (1 << 21, 5):
        monkeypatch.setattr(A, "_TERMS", terms)
        for shape in ((7, 9, 4), (1, 1, 1), (20, 3, 30)):
            x, y = (rng.integers(0, 3, s) * rng.integers(0, 2, s) for s in (shape[:2], shape[1:]))
            left, right = (A.Rows.of(*np.nonzero(m), len(m), m[np.nonzero(m)]) for m in (x, y))
            product, dense = left.times(right), np.zeros((shape[0], shape[2]), np.int64)
            dense[product.row_numbers(), product.columns] = product.values
            assert (dense == x @ y).all()


def test_texts_longer_than_a_batch(spark, tokenizers):
    text = " ".join(f"word{i % 700} {i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in A.align_tokens(docs).collect()}
    assert got[1]["n_a"] == len(tokenizers[0].encode([text])[0]) and got[1]["n_b"] == len(tokenizers[1].encode([text])[0])
    assert got[1]["n_links"] == sum(got[1]["links"]) and got[2]["n_a"] > 0
