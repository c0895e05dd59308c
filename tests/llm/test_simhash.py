from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sessionlens.llm import simhash as S

from .brute import words


def fingerprint(text):
    w = words(text)
    if not w:
        return 0
    n = min(3, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(len(w) - n + 1)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def component_ids(ids, prints):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    lowest = {}
    for i, doc_id in enumerate(ids):
        if doc_id is not None:
            lowest[root(i)] = min(doc_id, lowest.get(root(i), doc_id))
    return [lowest.get(root(i)) for i in range(len(ids))]


def test_fingerprints(spark):
    long = " ".join(f"w{i % 997} é{i}" for i in range(40_000))
    for text in (None, "", " \t\n", "one", "Two words", "A b C d", "é à b c ǅ", "x " * 50, long):
        got = S.fingerprint(None if text is None else text.encode())
        assert got % (1 << 64) == fingerprint(text)


def test_gray_rank(spark):
    codes = [i ^ (i >> 1) for i in range(1 << 10)]
    high = [c << 54 for c in codes]
    rows = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes + high], "c long").withColumn("r", S.gray_rank(F.col("c")))
    ranks = [r["r"] for r in rows.collect()]
    assert ranks[:1024] == [i - (1 << 63) for i in range(1024)] and sorted(ranks[1024:]) == ranks[1024:]


def near_prints(seed, n):
    """Random fingerprints, chains of near ones, a large group of near ones, and pairs at exactly 3 and 4 bits."""
    rng = random.Random(seed)
    out = [0, (1 << 64) - 1]
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 6])):
            out.append(base)
            base ^= sum(1 << k for k in rng.sample(range(64), rng.choice([1, 3, 4])))
    hub = rng.getrandbits(64)
    out += [hub ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(n // 3)]
    edge = rng.getrandbits(48)  # one front quarter for many
    out += [edge ^ (rng.getrandbits(16) << 20) for _ in range(n // 3)]
    return sorted(set(out))


@pytest.mark.parametrize("block, shelf", [(1 << 14, 32), (50, 32), (7, 3)])
def test_components_agree_with_brute_force(spark, monkeypatch, block, shelf):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "SHELF", shelf)
    prints = near_prints(block, 600)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = S.linked_fingerprints(spark.createDataFrame([(s,) for s in signed * 2], "fp long")).collect()
    place, up = {s: i for i, s in enumerate(signed)}, list(range(len(signed)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in links:
        a, b = root(place[r["a"]]), root(place[r["b"]])
        up[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(signed))] == component_ids(list(range(len(prints))), prints)


def test_hierarchy_prunes_only_what_is_far():
    codes = np.array(near_prints(5, 900), np.uint64)
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = codes[np.argsort(rank)]
    labels = S._linked(codes)
    near = (np.bitwise_count(codes[:, None] ^ codes) <= 3) & (codes[:, None] >> np.uint64(48) == codes >> np.uint64(48))
    assert all(labels[i] == labels[j] for i, j in np.argwhere(near))


def test_documents(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        w = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(rng.choice([0, 1, 2, 40, 200]))]
        for k in range(rng.choice([1, 1, 4])):
            if len(w) > 100:
                w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows) * 7 % 401, " ".join(w)))
    rows += [(None, rows[0][1]), (None, "a text of its own"), (999, None), (1000, ""), (1000, ""), (1001, "ONE"), (1002, "one")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, fp long, root string").repartition(3)
    got = sorted(map(repr, map(tuple, S.simhash_components(docs).collect())))
    prints = [fingerprint(t) for _, t in rows]
    want = component_ids([i for i, _ in rows], prints)
    assert got == sorted(repr((i, f"{p:016x}", c)) for (i, _), p, c in zip(rows, prints, want))
    assert S.simhash_components(docs.limit(0)).count() == 0
