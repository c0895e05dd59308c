"""Boosted trees on Spark by histogram aggregation: list-wise (LambdaRank), squared error or log loss.

Training rows are kept as lists, one row for a session's candidates with their features binned to a byte each, written
once. A level of a tree is one job: tasks work out the scores and gradients of their lists, add the gradients up by
(model, node, feature, bin), and one shuffle by (model, node, feature) brings the cells of all tasks together. Prefix sums
over the bins give the gain of every split; one row for each node, its best split, comes to the driver. The models of all types and
folds grow in the same jobs, so fifteen models cost as many jobs as one.

A type of ``TASK_CELLS`` at most takes no job for a level: one job has a task for each of its models, which holds all rows and grows
all trees, by the same sums and to the same splits.

Gradients are whole numbers (multiples of 2^-20), so that sums, splits and scores do not depend on the order of addition
or on how rows are dealt. A held-out fold's NDCG is summed up in the first job of every round, which gives each model a curve:
it stops after ``patience`` rounds without gain and is cut back to its best round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from sessionlens.functions.columns import stable_hash
from sessionlens.operators.ranking import smallest
from sessionlens.sources.sinks import drop_staged, staged

LIST_ROWS = 4096  # a longer session is stored in several parts, dealt by hash; it is trained as a whole
BIN_ROWS = 20_000  # rows of a type from which the bin edges are drawn; they come to the driver
KEEP = 16  # rounds after which scores are written out, so that tasks replay fewer trees
PIECE = 1 << 14  # rows that a kernel works on at a time: a column of them and its sums stay in a core's cache
TASK_ROWS = 50_000
TASK_CELLS = 1 << 26  # bytes of binned features: the models of a type of so many at most grow in a task each
UNIT = 1 << 20
Model = tuple[str, int]  # type and held-out fold


@dataclass(frozen=True)
class Boost:
    objective: str = "lambda"  # "lambda", "squared" or "log"
    rounds: int = 200
    depth: int = 5  # at most 2^depth leaves
    step: float = 0.1
    patience: int = 50
    bins: int = 64
    reg: float = 1.0
    least_rows: int = 20
    k: int = 20  # of NDCG, and places of which one must be in a pair
    columns: float = 1.0  # share of features that a tree may use
    seed: int = 42


@dataclass
class Tree:
    """Nodes as a heap: the children of i are 2i + 1 (bin <= cut) and 2i + 2; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = (2 << depth) - 1
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size))

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of binned features."""
        flat, rows = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        at, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            feature = self.feature[at[open_]]
            inner = feature >= 0
            if not inner.all():
                open_, feature = open_[inner], feature[inner]
            if not len(open_):
                return at
            here = at[open_]
            at[open_] = 2 * here + 1 + (flat[rows[open_] + feature] > self.cut[here])


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One byte for each value: 0 for missing, else 1 plus the number of edges not above it."""
    out = np.empty(values.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(values[:, i]), 0, 1 + np.searchsorted(e, values[:, i], "right"))
    return out


def bin_edges(rows: DataFrame, names: Sequence[str], bins: int) -> list[np.ndarray]:
    """Quantiles of each feature over ``BIN_ROWS`` rows drawn by hash: at most ``bins`` - 1 distinct values."""
    picked = smallest(rows, stable_hash(F.col("session"), F.col("aid"), seed=29), [F.col("session"), F.col("aid")], BIN_ROWS)
    table = picked.select([F.col(n).cast("double").alias(n) for n in names]).toArrow()
    out = []
    for n in names:
        values = table.column(n).to_numpy().astype(np.float64)
        values = np.sort(values[~np.isnan(values)])
        out.append(np.unique(values[[i * len(values) // bins for i in range(1, bins)]]) if len(values) else values)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _binning(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = binned(_matrix(batch.column("x"), len(edges)), edges)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in data], pa.binary())], [*batch.schema.names[:-1], "x"])

    return run


def as_doubles(names: Sequence[str]):
    return F.array(*[F.col(n).cast("double") for n in names])


def query_lists(rows: DataFrame, type_: str, names: Sequence[str], edges: list[np.ndarray], folds: int) -> DataFrame:
    """(type, session, part, parts, fold, aid, gt, x, base): a row for each list or part of one, with arrays in step, ordered by aid."""
    plain = rows.select("session", "aid", F.col("gt").cast("int").alias("gt"), F.col("fold").cast("int").alias("fold"), as_doubles(names).alias("x"))
    coded = plain.mapInArrow(_binning(edges), "session long, aid long, gt int, fold int, x binary")
    coded = staged(coded)
    sizes = coded.groupBy("session").agg(F.ceil(F.count(F.lit(1)) / F.lit(LIST_ROWS)).alias("parts"))
    dealt = coded.join(sizes, "session").withColumn("part", F.pmod(stable_hash(F.col("aid")), F.col("parts")))
    lists = dealt.groupBy("session", "part", "parts", "fold").agg(F.sort_array(F.collect_list(F.struct("aid", "gt", "x"))).alias("rows"))
    lists = lists.select(F.lit(type_).alias("type"), "session", "part", "parts", "fold", F.col("rows.aid").alias("aid"), F.col("rows.gt").alias("gt"), F.col("rows.x").alias("x"))
    return lists.withColumn("base", F.array_repeat(F.lit(0.0).cast("double"), F.size("aid") * folds))


def _whole(lists: DataFrame) -> DataFrame:
    """The same rows, the parts of a session one after the other in one task; sessions of one part stay where they are."""
    parted = F.col("parts") > 1
    return lists.where(~parted).unionByName(lists.where(parted).repartition("type", "session").sortWithinPartitions("type", "session", "part"))


def _bytes(x: pa.Array) -> np.ndarray:
    """Byte strings of one length as the rows of a matrix, without a copy."""
    ends = np.frombuffer(x.buffers()[1], np.int64 if pa.types.is_large_binary(x.type) else np.int32)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(x), -1)


class _Lists:
    """Some lists of one type as flat arrays, their rows as they are stored; a list is a session, whatever its parts."""

    def __init__(self, batch: pa.RecordBatch, folds: int):
        sizes = np.diff(batch.column("aid").offsets.to_numpy()).astype(np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]  # of the stored rows
        self.stored = np.repeat(np.arange(len(sizes)), sizes)
        _, first, number = np.unique(batch.column("session").to_numpy(), return_index=True, return_inverse=True)
        self.list, self.lists = number[self.stored], len(first)
        self.list_fold = batch.column("fold").to_numpy()[first]
        self.fold = self.list_fold[self.list]
        self.aid = batch.column("aid").flatten().to_numpy()
        self.y = batch.column("gt").flatten().to_numpy()
        self.x = _bytes(batch.column("x").flatten())
        if not folds:
            return
        base = batch.column("base").flatten().to_numpy()  # of each list: all its rows under fold 0, then 1, ...
        ends = np.repeat(self.starts[:-1] * folds, sizes) + np.arange(len(self.aid)) - np.repeat(self.starts[:-1], sizes)
        self.base = np.stack([base[ends + f * np.repeat(sizes, sizes)] for f in range(folds)]) if len(sizes) else np.zeros((folds, 0))

    @cached_property
    def columns(self) -> np.ndarray:
        return np.ascontiguousarray(self.x.T)

    @cached_property
    def by_aid(self) -> np.ndarray:
        """The rows by list and aid."""
        return np.lexsort((self.aid, self.list))

    def places(self, score: np.ndarray) -> np.ndarray:
        """Place from 0 of each row in its list by falling score, ties by aid."""
        order = np.lexsort((self.aid, -score, self.list))
        out = np.empty(len(order), np.int64)
        before = np.r_[0, np.cumsum(np.bincount(self.list, minlength=self.lists))]
        out[order] = np.arange(len(order)) - before[self.list[order]]
        return out

    def ideal(self, k: int) -> np.ndarray:
        """Of each list, the DCG at ``k`` with all positives in front; 0 without any."""
        positives = np.bincount(self.list, self.y > 0, self.lists).astype(np.int64)
        return np.r_[0.0, np.cumsum(1 / np.log2(np.arange(k) + 2))][np.minimum(positives, k)]

    def ndcg(self, score: np.ndarray, k: int) -> np.ndarray:
        """Of each list; NaN for lists without positives."""
        place = self.places(score)
        gain = np.where((self.y > 0) & (place < k), 1 / np.log2(place + 2), 0.0)
        with np.errstate(invalid="ignore"):
            return np.bincount(self.list, gain, self.lists) / np.where(self.ideal(k) > 0, self.ideal(k), np.nan)

    def gradients(self, score: np.ndarray, own: np.ndarray, settings: Boost) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives of the loss of the rows marked ``own``, in units; others 0."""
        if settings.objective == "lambda":
            g, h = self._lambdas(score, own, settings.k)
        elif settings.objective == "log":
            p = 1 / (1 + np.exp(-score))
            g, h = np.where(own, p - self.y, 0), np.where(own, p * (1 - p), 0)
        else:
            g, h = np.where(own, score - self.y, 0), own.astype(np.float64)
        return np.rint(g * UNIT), np.rint(h * UNIT)

    def _lambdas(self, score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Each positive pulls up against each negative of its list, by what swapping the two changes in NDCG.

        One of the two must be among the first ``k``: a positive there meets all negatives, another one those there, so
        that a list has at most k pairs for each row. Pairs are worked on some lists at a time, and a list of more than UNIT
        pairs in steps that begin with it: a row's sums are added in one order, whatever is worked on beside its list.
        """
        g, h = np.zeros(len(score)), np.zeros(len(score))
        place, ideal = self.places(score), self.ideal(k)
        rows = self.by_aid[own[self.by_aid]]
        good, bad = rows[self.y[rows] > 0], rows[self.y[rows] <= 0]
        near = bad[place[bad] < k]
        partner, front, number = np.r_[bad, near], place[good] < k, self.list[good]
        all_, few = (np.searchsorted(self.list[q], np.arange(self.lists + 1)) for q in (bad, near))
        first = np.where(front, all_[number], len(bad) + few[number])
        partners = np.where(front, all_[number + 1] - all_[number], few[number + 1] - few[number])
        before, at, begins = np.r_[0, np.cumsum(partners)], 0, np.searchsorted(number, number)
        while at < len(good):
            to = max(at + 1, int(np.searchsorted(before, before[at] + UNIT, "right")) - 1)
            if to < len(good) and begins[to] > at:
                to = int(begins[to])
            n = partners[at:to]
            p = np.repeat(good[at:to], n)
            q = partner[np.arange(n.sum()) + np.repeat(first[at:to] - (before[at:to] - before[at]), n)]
            change = np.abs(1 / np.log2(place[p] + 2) - 1 / np.log2(place[q] + 2)) / ideal[self.list[p]]
            rho = 1 / (1 + np.exp(score[p] - score[q]))
            for rows, sign in ((p, -1.0), (q, 1.0)):
                g += np.bincount(rows, sign * rho * change, len(score))
                h += np.bincount(rows, rho * (1 - rho) * change, len(score))
            at = to
        return g, h


def _by_type(batch: pa.RecordBatch, folds: int) -> Iterator[tuple[str, _Lists, np.ndarray]]:
    types = np.array(batch.column("type").to_pylist(), object)
    for t in sorted(set(types)):
        mine = np.flatnonzero(types == t)
        yield t, _Lists(batch.take(pa.array(mine)), folds), mine


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some sessions at a time, of about ``PIECE`` rows or one session; parts that follow each other stay together."""
    held, rows, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends, at = batch.column("aid").offsets.to_numpy(), 0
        keys = list(zip(batch.column("type").to_pylist(), batch.column("session").to_pylist()))
        begins = np.array([i for i, (a, b) in enumerate(zip([last, *keys], keys)) if a != b], np.int64)
        while len(begins := begins[np.searchsorted(ends[begins], ends[at] + PIECE - rows) :]):
            held.append(batch.slice(at, begins[0] - at))
            yield pa.concat_batches(held)
            held, rows, at = [], 0, int(begins[0])
        held.append(batch.slice(at))
        rows, last = rows + int(ends[-1] - ends[at]), keys[-1]
    if held:
        yield pa.concat_batches(held)


_CELLS = "model int, node int, feature int, g array<long>, h array<long>, n array<long>"


@dataclass
class Boosted:
    """The models of all types and folds, and how they came about."""

    names: list[str]
    edges: dict[str, list[np.ndarray]]
    settings: Boost
    folds: int
    trees: dict[Model, list[Tree]] = field(default_factory=dict)
    curves: dict[Model, list[float]] = field(default_factory=dict)  # NDCG after 0, 1, 2, ... rounds
    first_splits: dict[Model, tuple] = field(default_factory=dict)  # feature, bin, gain, rows left and right of the first root

    def best_round(self, model: Model) -> int:
        return 1 + int(np.argmax(self.curves[model][1:]))

    def kept(self, model: Model) -> list[Tree]:
        return self.trees[model][: self.best_round(model)]

    def curve(self, spark) -> DataFrame:
        """(type, fold, round, ndcg, best) of all rounds that were run."""
        rows = [(t, f, r, v, r == self.best_round((t, f))) for (t, f), c in self.curves.items() for r, v in enumerate(c) if r]
        return spark.createDataFrame(rows, "type string, fold int, round int, ndcg double, best boolean")

    def held_out(self, lists: DataFrame) -> DataFrame:
        """(session, aid, type, fold, gt, score): every row scored by the model that has not seen its session."""
        kept, folds = {m: self.kept(m) for m in self.trees}, self.folds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches):
                sessions = batch.column("session").to_numpy()
                for t, own, mine in _by_type(batch, folds):
                    score = np.zeros(len(own.aid))
                    for f in np.unique(own.fold).tolist():
                        rows = own.fold == f
                        score[rows] = _scores(kept.get((t, f), []), own.x[rows])
                    columns = [pa.array(sessions[mine][own.stored]), pa.array(own.aid), pa.array([t] * len(score)), pa.array(own.fold), pa.array(own.y.astype(np.int64)), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(columns, ["session", "aid", "type", "fold", "gt", "score"])

        return lists.mapInArrow(run, "session long, aid long, type string, fold int, gt long, score double")

    def fold_scores(self, features: DataFrame) -> DataFrame:
        """(session, aid, type, fold, score) of all models on all rows, in one pass over the features."""
        kept, edges = {m: self.kept(m) for m in self.trees}, self.edges

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = _matrix(batch.column("x"), len(self.names))
                x = {t: binned(values, e) for t, e in edges.items()}
                for (t, f), trees in kept.items():
                    n = batch.num_rows
                    columns = [batch.column("session"), batch.column("aid"), pa.array([t] * n), pa.array(np.full(n, f, np.int32)), pa.array(_scores(trees, x[t]))]
                    yield pa.RecordBatch.from_arrays(columns, ["session", "aid", "type", "fold", "score"])

        return features.select("session", "aid", as_doubles(self.names).alias("x")).mapInArrow(run, "session long, aid long, type string, fold int, score double")


def _scores(trees: list[Tree], x: np.ndarray, base: np.ndarray | float = 0.0) -> np.ndarray:
    out = base + np.zeros(len(x))
    for tree in trees:
        out += tree.value[tree.nodes(x)]
    return out


def _level(models: list[Model], pending: dict[Model, list[Tree]], partial: dict[Model, Tree], frontier: dict[Model, list[int]], settings: Boost, folds: int, level: int, used: dict[Model, np.ndarray]):
    """Kernel of a level: cells of the gradient histograms, and the sums of NDCG at the first level."""
    numbers = {m: i for i, m in enumerate(models)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[Model, np.ndarray] = {}
        metric: dict[Model, list[int]] = {}
        for batch in _pieces(batches):
            for t, own, _ in _by_type(batch, folds):
                for m in [m for m in numbers if m[0] == t]:
                    score = _scores(pending[m], own.x, own.base[m[1]])
                    train = own.fold != m[1]
                    if level == 0:
                        values = own.ndcg(score, settings.k)[own.list_fold == m[1]]
                        values = values[~np.isnan(values)]
                        total = metric.setdefault(m, [0, 0])
                        total[0] += int(np.rint(values * UNIT).sum())
                        total[1] += len(values)
                    if not frontier.get(m):
                        continue
                    g, h = own.gradients(score, train, settings)
                    place = np.full(len(partial[m].feature), -1)
                    place[frontier[m]] = np.arange(len(frontier[m]))
                    node = place[partial[m].nodes(own.x)]
                    rows = np.flatnonzero(train & (node >= 0))
                    if m not in sums:
                        sums[m] = np.zeros((3, len(frontier[m]), len(used[m]), settings.bins + 1), np.int64)
                    _add_cells(sums[m], node[rows], own.columns, rows, used[m], g[rows], h[rows])
        names, depth = [c.split()[0] for c in _CELLS.split(", ")], settings.bins + 1
        for m, cells in sums.items():
            cells = cells.reshape(3, -1, depth)  # by node and feature
            full = np.flatnonzero(cells[2].any(axis=1))
            node, feature = np.divmod(full, len(used[m]))
            columns = [np.full(len(full), numbers[m]), np.array(frontier[m])[node], used[m][feature]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in columns], *[_lists_of(c[full]) for c in cells]], names)
        for m, total in metric.items():
            whole = [_lists_of(np.array([[v] + [0] * settings.bins])) for v in (total[0], 0, total[1])]
            yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in (numbers[m], -1, -1)], *whole], names)

    return run


def _add_cells(sums: np.ndarray, node: np.ndarray, columns: np.ndarray, rows: np.ndarray, used: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
    """Adds g, h and the number of ``rows`` to ``sums`` (3, node, feature, bin), a feature at a time."""
    nodes, depth = sums.shape[1], sums.shape[3]
    first, all_ = node * depth, len(rows) == columns.shape[1]
    for i, f in enumerate(used):
        at = first + (columns[f] if all_ else columns[f][rows])
        for k, found in enumerate((np.bincount(at, g, nodes * depth), np.bincount(at, h, nodes * depth), np.bincount(at, minlength=nodes * depth))):
            sums[k, :, i] += found.reshape(nodes, depth).astype(np.int64)


def _lists_of(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of whole numbers as a list column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel().astype(np.int64)))


_SPLIT = "model int, node int, feature int, gain double, bin int, g long, h long, n long, gg long, hh long, nn long"


def _cuts(total: np.ndarray, settings: Boost) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of cells (3, row, bin): the best cut of each row, its gain (NaN where none fits), and g, h, n left of it and in all."""
    g, h, n = sums = np.cumsum(total, axis=2)
    part = lambda g, h: (g / UNIT) * (g / UNIT) / (h / UNIT + settings.reg)
    gg, hh, nn = (x[:, -1:] for x in (g, h, n))
    gain = part(g, h) + part(gg - g, hh - h) - part(gg, hh)
    fits = (n >= settings.least_rows) & (nn - n >= settings.least_rows) & (gain > 1e-6)
    best = np.argmax(np.where(fits, gain, -np.inf), axis=1)
    rows = np.arange(len(best))
    return best, np.where(fits[rows, best], gain[rows, best], np.nan), sums[:, rows, best], sums[:, :, -1]


def _split_kernel(settings: Boost):
    """Adds the cells of all tasks up, and finds the best cut of each (model, node, feature); gain NaN where none fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth, places, total = settings.bins + 1, {}, np.zeros((3, 0, settings.bins + 1), np.int64)
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("model", "node", "feature")]))
            at = np.array([places.setdefault(k, len(places)) for k in keys], np.int64)
            total = np.pad(total, ((0, 0), (0, len(places) - total.shape[1]), (0, 0)))
            for k, c in enumerate("ghn"):
                np.add.at(total[k], at, batch.column(c).flatten().to_numpy().reshape(-1, depth))
        if not places:
            return
        best, gain, left, whole = _cuts(total, settings)
        keys = np.array(list(places), np.int32)
        columns = [pa.array(keys[:, k]) for k in range(3)]
        columns += [pa.array(gain), pa.array(best.astype(np.int32))]
        columns += [pa.array(x) for x in (*left, *whole)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SPLIT.split(", ")])

    return run


def best_splits(cells: DataFrame, settings: Boost) -> DataFrame:
    """Of the cells (model, node, feature, and g, h, n by bin): the sums of each node and its best split, if it has one.

    Equal gains go to the lower feature and bin.
    """
    cuts = cells.repartition("model", "node", "feature").mapInArrow(_split_kernel(settings), _SPLIT)
    split = F.struct("gain", (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), "g", "h", "n")
    best = F.max(F.when(~F.isnan("gain"), split)).alias("split")
    return cuts.groupBy("model", "node").agg(F.max("gg").alias("g"), F.max("hh").alias("h"), F.max("nn").alias("n"), best)


def _used(settings: Boost, width: int, round_: int, model: int) -> np.ndarray:
    """The features that a model's tree may use."""
    count = max(1, round(settings.columns * width))
    return np.sort(np.random.default_rng([settings.seed, round_, model]).choice(width, count, replace=False))


def _on(curve: list[float], patience: int) -> bool:
    return len(curve) < 2 or len(curve) - 2 - int(np.argmax(curve[1:])) < patience


def _tree(columns: np.ndarray, g: np.ndarray, h: np.ndarray, used: np.ndarray, settings: Boost) -> tuple[Tree, np.ndarray, list[float]]:
    """A tree on rows that are all here, the leaf of each row, and the first split.

    The cells of one of two children, that of fewer rows, are added up; those of the other are what is left of their parent's.
    """
    tree, at, first = Tree.empty(settings.depth), np.zeros(len(g), np.int64), []
    cells, fresh, rest = {}, [0] if len(g) and len(used) else [], []
    for level in range(settings.depth):
        place = np.full(len(tree.feature), -1)
        place[fresh] = np.arange(len(fresh))
        rows = np.flatnonzero(place[at] >= 0)
        sums = np.zeros((3, len(fresh), len(used), settings.bins + 1), np.int64)
        for some in (rows[i : i + PIECE] for i in range(0, len(rows), PIECE)):
            _add_cells(sums, place[at[some]], columns, some, used, g[some], h[some])
        own = {i: sums[:, k] for k, i in enumerate(fresh)}
        cells = own | {i: cells[(i - 1) // 2] - own[i + 1 if i % 2 else i - 1] for i in rest}
        fresh, rest = [], []
        for i, total in cells.items():
            best, gain, left, whole = _cuts(total, settings)
            if np.isnan(gain).all():
                continue
            f = int(np.nanargmax(gain))  # equal gains go to the lower feature
            tree.feature[i], tree.cut[i] = used[f], best[f]
            first = first or [int(used[f]), int(best[f]), round(float(gain[f]), 6), int(left[2, f]), int(whole[2, f] - left[2, f])]
            for child, (cg, ch) in ((2 * i + 1, left[:2, f]), (2 * i + 2, whole[:2, f] - left[:2, f])):
                tree.value[child] = _leaf(int(cg), int(ch), settings)
            pair = [2 * i + 1, 2 * i + 2] if 2 * left[2, f] <= whole[2, f] else [2 * i + 2, 2 * i + 1]
            fresh.append(pair[0])
            rest.append(pair[1])
        if not fresh:
            if not level:
                tree.value[0] = _leaf(int(g.sum()), int(h.sum()), settings)
            break
        moved = np.flatnonzero(tree.feature[at] >= 0)
        here = at[moved]
        at[moved] = 2 * here + 1 + (columns[tree.feature[here], moved] > tree.cut[here])
    return tree, at, first


_GROWN = "model int, feature array<int>, cut array<int>, value array<double>, curve array<double>, first array<double>"


def _grown(models: list[Model], settings: Boost):
    """Kernel of whole models: the trees of one after the other, the curve and the first split of a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        batch = pa.concat_batches(batches)
        number = batch.column("model")[0].as_py()
        out = batch.column("fold").to_numpy() == models[number][1]
        train, held = (_Lists(batch.filter(pa.array(own)), 0) if own.any() else None for own in (~out, out))
        columns = np.zeros((batch.column("x").flatten()[0].as_buffer().size, 0), np.uint8) if train is None else train.columns
        # a feature of one value has no cut, and of two that are equal the lower one is taken
        same = {c.tobytes(): f for f, c in reversed(list(enumerate(columns)))}
        same = [-1 if (c == c[:1]).all() else same[c.tobytes()] for c in columns]
        score, trees, curve, first = np.zeros(columns.shape[1]), [], [], []
        seen = np.zeros(0 if held is None else len(held.aid))
        for round_ in range(settings.rounds + 1):
            values = np.zeros(0) if held is None else held.ndcg(seen, settings.k)
            values = values[~np.isnan(values)]
            curve.append(round(int(np.rint(values * UNIT).sum()) / UNIT / max(1, len(values)), 6))
            if round_ == settings.rounds:
                break
            used = {}
            for f in _used(settings, len(columns), round_, number):
                if same[f] >= 0:
                    used.setdefault(same[f], f)
            g, h = (np.zeros(0), np.zeros(0)) if train is None else train.gradients(score, np.full(len(score), True), settings)
            tree, at, split = _tree(columns, g, h, np.array(list(used.values()), np.int64), settings)
            first = first or split
            trees.append(tree)
            score += tree.value[at]
            if held is not None:
                seen += tree.value[tree.nodes(held.x)]
            if not _on(curve, settings.patience):
                break
        whole = [np.concatenate([getattr(t, c) for t in trees]) for c in ("feature", "cut", "value")] if trees else [[], [], []]
        columns = [[number], *[[np.asarray(c)] for c in (*whole, curve, first)]]
        types = [pa.int32(), *[pa.list_(x) for x in (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _GROWN.split(", ")])

    return run


def _grow_in_tasks(out: Boosted, lists: DataFrame, models: list[Model], types: dict[str, int]) -> None:
    """Grows the models of ``types`` (rows by type), a task each: those of most rows first."""
    order = sorted((m for m in models if m[0] in types), key=lambda m: -types[m[0]])
    of = {t: [(models.index(m), i) for i, m in enumerate(order) if m[0] == t] for t in types}
    pairs = F.create_map(*[x for t, own in of.items() for x in (F.lit(t), F.array(*[F.struct(F.lit(a).alias("model"), F.lit(b).alias("at")) for a, b in own]))])
    each = lists.where(F.col("type").isin(*types)).select("type", "session", "fold", "aid", "gt", "x", F.inline(pairs[F.col("type")]))
    found = each.repartitionById(len(order), F.col("at")).drop("at", "type").mapInArrow(_grown(models, out.settings), _GROWN)
    for r in found.collect():  # a row for each model
        m, size = models[r["model"]], len(Tree.empty(out.settings.depth).feature)
        parts = [np.array(r[c], d).reshape(-1, size) for c, d in (("feature", np.int32), ("cut", np.int32), ("value", np.float64))]
        out.trees[m], out.curves[m] = [Tree(*t) for t in zip(*parts)], list(r["curve"])
        if r["first"]:
            f, cut, gain, left, right = r["first"]
            out.first_splits[m] = (int(f), int(cut), gain, int(left), int(right))


def fit_boosted(training: dict[str, DataFrame], names: Sequence[str], settings: Boost = Boost(), folds: int = 5) -> tuple[Boosted, DataFrame]:
    """Models of every type and fold, and the lists they were trained on.

    ``training`` has rows (session, aid, gt, fold, features) by type, a session's rows in one fold. Missing features
    are a bin of their own. A session is one list, however long: its parts meet in the task that works on it. A list without positives or without negatives teaches a list-wise model nothing.
    """
    spark = next(iter(training.values())).sparkSession

    def binned_lists(t: str) -> tuple[list[np.ndarray], DataFrame, int]:
        edges = bin_edges(training[t], names, settings.bins)
        return edges, query_lists(training[t], t, names, edges, folds), training[t].count()

    with ThreadPoolExecutor(len(training)) as pool:
        edges, parts, rows = (dict(zip(training, x)) for x in zip(*pool.map(inheritable_thread_target(spark)(binned_lists), training)))
    lists = reduce(DataFrame.unionByName, parts.values())
    cores = spark.sparkContext.defaultParallelism
    lists = staged(lists.repartition(max(cores, sum(rows.values()) // TASK_ROWS), "type", "session", "part"))
    whole = _whole if not lists.where("parts > 1").isEmpty() else lambda rows: rows
    models = [(t, f) for t in training for f in range(folds)]
    out = Boosted(list(names), edges, settings, folds, {m: [] for m in models}, {m: [] for m in models})
    if small := {t: n for t, n in rows.items() if 0 < n * len(names) <= TASK_CELLS}:
        _grow_in_tasks(out, lists, models, small)
    growing, written, scored = [m for m in models if m[0] not in small], 0, lists.where(~F.col("type").isin(*small)) if small else lists
    if not growing:
        return out, lists
    for round_ in range(settings.rounds + 1):
        last = round_ == settings.rounds
        pending = {m: out.trees[m][written:] for m in models}
        partial = {m: Tree.empty(settings.depth) for m in growing}
        frontier = {m: [] if last else [0] for m in growing}
        used = {m: _used(settings, len(names), round_, i) for i, m in enumerate(models)}
        for level in range(settings.depth):
            kernel = _level(growing, pending, partial, frontier, settings, folds, level, used)
            found = best_splits(whole(scored).mapInArrow(kernel, _CELLS), settings).collect()  # a row for each open node
            below: dict[Model, list[int]] = {m: [] for m in growing}
            for r in found:
                m, i, split = growing[r["model"]], r["node"], r["split"]
                if i < 0:
                    out.curves[m].append(round(r["g"] / UNIT / max(1, r["n"]), 6))
                    continue
                tree = partial[m]
                if split is None:
                    tree.value[i] = _leaf(r["g"], r["h"], settings)
                    continue
                tree.feature[i], tree.cut[i] = -split["feature"], -split["bin"]
                for child, (g, h) in ((2 * i + 1, (split["g"], split["h"])), (2 * i + 2, (r["g"] - split["g"], r["h"] - split["h"]))):
                    tree.value[child] = _leaf(g, h, settings)
                    below[m].append(child)
                if i == 0 and m not in out.first_splits:
                    out.first_splits[m] = (-split["feature"], -split["bin"], round(split["gain"], 6), split["n"], r["n"] - split["n"])
            frontier = {m: sorted(c) for m, c in below.items()}
            if not any(frontier.values()):
                break
        if last:
            break
        for m in growing:
            out.trees[m].append(partial[m])
        growing = [m for m in growing if _on(out.curves[m], settings.patience)]
        if not growing:
            break
        if (round_ + 1) % KEEP == 0:
            onward = staged(scored.mapInArrow(_rescored({m: out.trees[m][written:] for m in models}, folds), lists.schema))
            if written:
                drop_staged(scored)
            scored, written = onward, round_ + 1
    return out, lists


def _leaf(g: int, h: int, settings: Boost) -> float:
    return -settings.step * (g / UNIT) / (h / UNIT + settings.reg)


def _rescored(trees: dict[Model, list[Tree]], folds: int):
    """The lists with the trees' scores added to ``base``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            base = [None] * batch.num_rows
            for t, own, mine in _by_type(batch, folds):
                total = np.stack([_scores(trees.get((t, f), []), own.x, own.base[f]) for f in range(folds)])
                for i, a, b in zip(mine.tolist(), own.starts, own.starts[1:]):
                    base[i] = total[:, a:b].ravel()
            columns = [c if n != "base" else pa.array(base, pa.list_(pa.float64())) for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run
