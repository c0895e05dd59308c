"""A quality classifier: a generalised additive model with pairwise interactions.

Measures of each whole text (shares of characters, of repeated words and lines and the like, in no particular
language) are cut into bins. Round after round, each measure in turn gets a shallow tree on its bins, fitted to
what the model still gets wrong, and a small step towards it is added to the measure's lookup table; the pairs of
measures that say most about the remaining error then get tables of their own in the same way. A score is the sum
of looked-up values, put through the logistic function.

Measures and scores are computed in Arrow batches over all rows; only the fit uses a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import shingle_hashes, slices, word_hashes
from sessionlens.sources.sinks import staged

FIT_ROWS = 50_000  # labelled rows that the fit uses at most: those with the smallest hash of their id
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS, PATIENCE, RATE = 300, 25, 0.15
LEAST_IN_LEAF = 5
CUT = 0.7

MEASURES = (
    "log_words", "word_length", "upper", "punctuation", "digits", "other_bytes", "bare_words", "marked_words", "distinct_words",
    "top_word", "echoed_words", "repeated_runs", "repeated_lines", "line_words", "closed_lines", "entropy", "longest_word", "odd_signs",
)

_KIND = np.zeros(256, np.int64)  # 0 other, 1 space, 2 lower, 3 upper, 4 digit, 5 common mark, 6 odd sign
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 2, 3, 4
_KIND[[x for x in range(33, 127) if not chr(x).isalnum()]] = 6
_KIND[[ord(x) for x in ".,;:!?'\"()-"]] = 5


def _measure(text: bytes, words: np.ndarray) -> list[float]:
    data = np.frombuffer(text, np.uint8)
    if not len(words):
        return [0.0] * len(MEASURES)
    kinds = _KIND[data]
    n = np.bincount(kinds, minlength=7)
    full, letters = max(1, len(data) - n[1]), max(1, n[0] + n[2] + n[3])
    start = np.flatnonzero((kinds != 1) & np.r_[True, kinds[:-1] == 1])
    stop = np.flatnonzero((kinds != 1) & np.r_[kinds[1:] == 1, True])
    named = np.add.reduceat((kinds == 0) | (kinds == 2) | (kinds == 3), start) > 0
    counts = np.unique(words, return_counts=True)[1]
    shingles = shingle_hashes(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = np.bincount(data, minlength=256) / len(data)
    shares = shares[shares > 0]
    return [
        np.log1p(len(words)), full / len(words), n[3] / letters, (n[5] + n[6]) / full, n[4] / full, n[0] / full,
        1 - named.mean(), (kinds[stop] >= 5).mean(), len(counts) / len(words) ** 0.9, counts.max() / len(words),
        (words[1:] == words[:-1]).mean() if len(words) > 1 else 0.0, 1 - len(np.unique(shingles)) / len(shingles),
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)), -float((shares * np.log2(shares)).sum()),
        np.log1p((stop - start).max()), n[6] / full,
    ]


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 512):
        texts = batch.column("text")
        rows = [_measure(t or b"", w) for t, w in zip(texts.cast(pa.binary()).to_pylist(), word_hashes(texts))]
        columns = np.array(rows, float).reshape(-1, len(MEASURES)).T
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", *MEASURES])


@dataclass
class AdditiveModel:
    """Lookup tables by bin: one for each measure, and one for each chosen pair on coarser bins."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, coarse: bool = False) -> np.ndarray:
        edges = self.coarse if coarse else self.edges
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if not self.edges:
            return total
        fine, coarse = self.bins(x), self.bins(x, True)
        for j, table in enumerate(self.tables):
            total += table[fine[:, j]]
        for (j, k), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[:, j], coarse[:, k]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; 0 if none."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    ok = (nl >= LEAST_IN_LEAF) & (nr >= LEAST_IN_LEAF)
    if not ok.any():
        return 0.0, 0
    gain = np.where(ok, gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), 0.0)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Step for each bin from a tree of ``depth`` on one measure."""
    gain, at = _best_cut(g, h, n) if depth else (0.0, 0)
    if gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.r_[_tree(g[:at], h[:at], n[:at], depth - 1), _tree(g[at:], h[at:], n[at:], depth - 1)]


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Steps for a grid from a tree that cuts one measure, and then the other on either side; and its gain."""
    best, out = 0.0, np.zeros_like(g)
    for turn in (False, True):
        a, b, c = (x.T if turn else x for x in (g, h, n))
        for at in range(1, len(a)):
            gain, step = 0.0, np.empty_like(a)
            for part in (slice(0, at), slice(at, None)):
                own = a[part].sum(0), b[part].sum(0), c[part].sum(0)
                more, cut = _best_cut(*own)
                gain += more + own[0].sum() ** 2 / (own[1].sum() + 1)
                for side in ((slice(0, cut), slice(cut, None)) if more > 0 else (slice(None),)):
                    step[part, side] = own[0][side].sum() / (own[1][side].sum() + 1)
            if gain > best:
                best, out = gain, step.T if turn else step
    return out, best


def fit_additive(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> AdditiveModel:
    """Fit to rows ``x`` with labels ``y`` of 0 and 1; the rows marked in ``held`` only say when to stop.

    Without rows of both labels the model is a constant.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(np.unique(y[~held])) < 2:
        return model

    def cuts(count: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, count + 1)[1:-1])) for j in range(x.shape[1])]

    model.edges, model.coarse = cuts(BINS), cuts(PAIR_BINS)
    fine, coarse = model.bins(x), model.bins(x, True)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total, fit = np.full(len(y), model.intercept), ~held

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total[fit]))
        return y[fit] - p, p * (1 - p)

    def loss() -> float:
        on = held if held.any() else fit
        return float(np.logaddexp(0, np.where(y[on] == 1, -total[on], total[on])).mean())

    def cycle(tables: list[np.ndarray], places: list[np.ndarray], step) -> None:
        """Rounds of steps for each table in turn, back to the best round at the end."""
        nonlocal total
        best, kept, since = loss(), ([t.copy() for t in tables], total.copy()), 0
        for _ in range(ROUNDS):
            for table, place in zip(tables, places):
                g, h = residual()
                sums = [np.bincount(place[fit], w, table.size).reshape(table.shape) for w in (g, h, None)]
                change = RATE * step(*sums)
                table += change
                total = total + change.ravel()[place]
            now = loss()
            best, kept, since = (now, ([t.copy() for t in tables], total.copy()), 0) if now < best - 1e-6 else (best, kept, since + 1)
            if since >= PATIENCE:
                break
        for table, value in zip(tables, kept[0]):
            table[...] = value
        total = kept[1]

    cycle(model.tables, [fine[:, j] for j in range(x.shape[1])], _tree)
    g, h = residual()
    gains = []
    for j, k in combinations(range(x.shape[1]), 2):
        shape = len(model.coarse[j]) + 1, len(model.coarse[k]) + 1
        place = coarse[fit, j] * shape[1] + coarse[fit, k]
        sums = [np.bincount(place, w, shape[0] * shape[1]).reshape(shape) for w in (g, h, None)]
        gains.append((_pair_tree(*sums)[1], (j, k), shape))
    chosen = sorted(gains, key=lambda z: (-z[0], z[1]))[:PAIRS]
    model.pairs = [pair for _, pair, _ in chosen]
    model.pair_tables = [np.zeros(shape) for _, _, shape in chosen]
    places = [coarse[:, j] * t.shape[1] + coarse[:, k] for (j, k), t in zip(model.pairs, model.pair_tables)]
    cycle(model.pair_tables, places, lambda *sums: _pair_tree(*sums)[0])
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Learns from labels of 0 and 1 whose fold is not ``held_fold``, from the FIT_ROWS of them with the smallest hashes; labels of other
    values and rows without a label are not learned from. Nothing but the text makes a score. Null and empty texts
    and texts of white space have measures of 0 and are scored like all others. A null id is never held out.
    Repeated rows get the same score. Without labels of both kinds the score is a constant. Other columns are not
    looked at. An empty table gives an empty result.
    """
    only = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    measured = staged(only.mapInArrow(_measures, "doc_id long, " + ", ".join(f"{m} double" for m in MEASURES)))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    known = known.where(F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != held_fold))
    # The rows with the smallest hashes: a threshold leaves a few more than FIT_ROWS labels, before anything is joined or sorted.
    known = staged(known.withColumn("place", F.xxhash64("doc_id")))
    below = int(2**64 * min(1.0, 1.2 * FIT_ROWS / max(1, known.count()))) - 2**63 - 1
    asked = known.where(F.col("place") <= below)
    sample = measured.join(asked, "doc_id").distinct().orderBy("place", "doc_id", "label", *MEASURES).limit(FIT_ROWS).drop("place").toPandas()
    stop = sample["doc_id"].map(lambda i: hash((int(i), 7)) % 6 == 0).to_numpy(bool) if len(sample) else np.zeros(0, bool)
    model = fit_additive(sample[list(MEASURES)].to_numpy(float), sample["label"].to_numpy(float), stop)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(m).to_numpy(zero_copy_only=False) for m in MEASURES], 1)
            value = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array((value >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = measured.mapInArrow(score, "doc_id long, score double, predicted int")
    held_out = F.coalesce(fold(F.col("doc_id")) == held_fold, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
