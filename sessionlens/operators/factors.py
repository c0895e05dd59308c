"""Item and session vectors: skip-gram as a factorised PMI matrix, WARP, and one shared table for next items.

Tables of vectors never come to the driver. The factorisation works by sparse products as joins and sums, with matrices of
the size of a vector (squared) on the driver. The two learners deal rows in blocks and walk strata of block pairs
without a block in common, so all pairs of a stratum are updated side by side and no update is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.columns import round6
from sessionlens.functions.vectors import matrix
from sessionlens.operators.candidates import move_counts
from sessionlens.operators.models import VECTOR, window_pairs
from sessionlens.sources.sinks import drop_staged, staged

# ---- skip-gram with negative sampling ------------------------------------------------------


def shifted_pmi(pairs: DataFrame, negatives: int = 1, power: float = 0.75) -> DataFrame:
    """Cells above zero of log(P(a, b) / (P(a) Q(b))) - log(negatives): (aid, aid_near, pmi).

    ``pairs`` has (aid, aid_near, n), both orders. Q is the distribution negatives are drawn from, counts to the
    ``power``. Skip-gram with ``negatives`` negative samples has this matrix as its optimum.
    """
    rows = pairs.groupBy("aid").agg(F.sum("n").alias("n_a"))
    columns = pairs.groupBy("aid_near").agg(F.pow(F.sum("n").cast("double"), F.lit(power).cast("double")).alias("n_b"))
    columns = staged(columns)
    whole = columns.agg(F.sum("n_b").alias("all_b")).scalar()
    cell = F.log(F.col("n") * whole / (F.col("n_a") * F.col("n_b"))) - F.log(F.lit(float(negatives)))
    met = pairs.join(rows, "aid").join(columns, "aid_near")
    return met.select("aid", "aid_near", round6(cell).alias("pmi")).where("pmi > 0")


def skip_gram_vectors(events: DataFrame, size: int = 32, window: int = 25, negatives: int = 1, passes: int = 2, spare: int = 8) -> DataFrame:
    """Item vectors (aid, vector) of ``size`` numbers from who stands near whom within ``window`` places.

    Randomised subspace iteration on the shifted PMI matrix. Items without a cell above zero have no vector.
    """
    pairs = window_pairs(events, window)
    both = pairs.union(pairs.select("aid_near", "aid", "n")).groupBy("aid", "aid_near").agg(F.sum("n").alias("n"))
    cells = staged(shifted_pmi(staged(both), negatives))
    return factorised(cells, size, passes, spare)


def factorised(cells: DataFrame, size: int, passes: int = 2, spare: int = 8) -> DataFrame:
    """(aid, vector): left singular vectors of the sparse matrix (aid, aid_near, pmi), each times the root of its singular value."""
    width = size + spare
    start = cells.select(F.col("aid_near").alias("id")).distinct()
    kick = [(F.xxhash64("id", F.lit(i)) / F.lit(2.0**63)).alias(f"c{i}") for i in range(width)]  # even noise, the same on any partitioning
    basis = _product(cells, start.select("id", F.array(*kick).alias("v")), "aid", "aid_near", width)
    for _ in range(passes):
        basis = _orthogonal(basis, width)
        back = _orthogonal(_product(cells, basis, "aid_near", "aid", width), width)
        basis = _product(cells, back, "aid", "aid_near", width)
    basis = _orthogonal(basis, width)
    small = _gram(_product(cells, basis, "aid_near", "aid", width), width)  # B B^T of B = Q^T M
    values, turns = np.linalg.eigh(small)
    order = np.argsort(values)[::-1][:size]
    scale = turns[:, order] * np.maximum(values[order], 0) ** 0.25
    return staged(_turned(basis, scale).select(F.col("id").alias("aid"), F.col("v").alias(VECTOR)))


def _product(cells: DataFrame, vectors: DataFrame, to: str, over: str, width: int) -> DataFrame:
    """The matrix (or its transpose) times a tall one: (id, v)."""
    met = cells.join(vectors, cells[over] == vectors["id"]).select(F.col(to).alias("id"), "pmi", "v")
    sums = met.groupBy("id").agg(*[F.sum(F.col("pmi") * F.col("v")[i]).alias(f"s{i}") for i in range(width)])
    return staged(sums.select("id", F.array(*[f"s{i}" for i in range(width)]).alias("v")))


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """V^T V: every task adds up its own, and width^2 sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"))
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "value"])

    out = np.zeros(width * width)
    for r in vectors.select("v").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out.reshape(width, width)


def _turned(vectors: DataFrame, right: np.ndarray) -> DataFrame:
    """Every vector times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v")) @ right
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], ["id", "v"])

    return vectors.select("id", "v").mapInArrow(run, "id long, v array<double>")


def _orthogonal(vectors: DataFrame, width: int) -> DataFrame:
    """The same span with orthonormal columns; columns that add nothing become zero."""
    values, turns = np.linalg.eigh(_gram(vectors, width))
    keep = values > max(values.max(), 0) * 1e-12
    return staged(_turned(vectors, turns * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0)))


# ---- learners on strata of blocks ----------------------------------------------------------


def _start(ids: np.ndarray, size: int, seed: int) -> np.ndarray:
    """First vectors, the same for an id wherever it is."""
    return np.stack([np.random.default_rng([seed, int(i) & 0x7FFFFFFF, int(i) >> 31 & 0x7FFFFFFF]).standard_normal(size) for i in ids]) / size if len(ids) else np.zeros((0, size))


BLOCK_PAIRS, BLOCK_IDS = 1_000_000, 200_000


def _enough(rows: DataFrame, blocks: int | None, *columns: str) -> int:
    """An even number of blocks, so that a pair of blocks has about BLOCK_PAIRS rows and a block BLOCK_IDS ids at most."""
    if blocks is None:
        ids = max(rows.select(c).distinct().count() for c in columns)
        blocks = max(4, math.isqrt(rows.count() // BLOCK_PAIRS) + 1, ids // BLOCK_IDS + 1)
    return blocks + blocks % 2


def _block_of(column: str, blocks: int, seed: int):
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(blocks)).cast("int")


def _packed(rows: DataFrame, column: str, blocks: int, size: int, seed: int, last: float | None = None) -> DataFrame:
    """(block, ids, vectors, sums): the ids of a block with their vectors (``last``: what they end with) and sums of squared steps as bytes."""
    lists = rows.select(F.col(column).cast("long").alias("id")).distinct().withColumn("block", _block_of("id", blocks, seed))
    lists = lists.groupBy("block").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column("block").to_pylist(), batch.column("ids")):
                ids = ids.values.to_numpy()
                v = _start(ids, size, seed)
                if last is not None:
                    v[:, -1] = last
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([np.ones_like(v).tobytes()], pa.binary())], ["block", "ids", "vectors", "sums"])

    return staged(lists.mapInArrow(run, _SIDE))


_SIDE = "block int, ids binary, vectors binary, sums binary"


class _Block:
    """Vectors of a block of ids, moved by steps that shrink as their squares add up."""

    def __init__(self, ids: bytes, vectors: bytes, sums: bytes, size: int, step: float):
        self.ids = np.frombuffer(ids, np.int64)
        self.v, self.sums = (np.frombuffer(x).reshape(-1, size).copy() for x in (vectors, sums))
        self.step = step

    def places(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)

    def move(self, rows: np.ndarray, g: np.ndarray) -> None:
        np.add.at(self.sums, rows, g * g)
        np.add.at(self.v, rows, -self.step * g / np.sqrt(self.sums[rows]))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.ids.tobytes(), self.v.tobytes(), self.sums.tobytes()


def _unpacked(side: DataFrame, name: str, size: int) -> DataFrame:
    """(name, vector), a row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v in zip(batch.column("ids").to_pylist(), batch.column("vectors").to_pylist()):
                ids, v = np.frombuffer(ids, np.int64), np.frombuffer(v)
                ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(ends, pa.array(v))], [name, VECTOR])

    return side.mapInArrow(run, f"{name} long, {VECTOR} array<double>")


def _warp_step(users: _Block, items: _Block, u: np.ndarray, i: np.ndarray, rng: np.random.Generator, trials: int, batch: int, reg: float) -> None:
    """Each positive against the first of ``trials`` drawn items that scores within one of it, weighed by its estimated rank."""
    known = np.sort(u * len(items.ids) + i)
    order = rng.permutation(len(u))
    for at in range(0, len(order), batch):
        own = order[at : at + batch]
        pu, pi = u[own], i[own]
        drawn = rng.integers(0, len(items.ids), (len(own), trials))
        codes = pu[:, None] * len(items.ids) + drawn
        other = known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] != codes
        good = np.einsum("nd,nd->n", users.v[pu], items.v[pi])
        bad = np.einsum("nd,ntd->nt", users.v[pu], items.v[drawn])
        violates = other & (bad > good[:, None] - 1)
        hit = violates.any(axis=1)
        if not hit.any():
            continue
        first = violates.argmax(axis=1)[hit]
        pu, pi, pj = pu[hit], pi[hit], drawn[hit, first]
        weight = np.log(np.maximum(1.0, (len(items.ids) - 1) // (first + 1)))[:, None]
        vu, vi, vj = users.v[pu], items.v[pi], items.v[pj]
        pull = weight * (vj - vi) + reg * vu
        pull[:, -1] = 0  # stays one: the item's last number is its own lead
        users.move(pu, pull)
        items.move(pi, reg * vi - weight * vu)
        items.move(pj, reg * vj + weight * vu)


def warp_vectors(interactions: DataFrame, size: int = 16, epochs: int = 30, blocks: int | None = None, step: float = 0.05, trials: int = 50, seed: int = 42, batch: int = 64, reg: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Session and item vectors from rows (session, aid), so that a session's items score above others: WARP.

    A score is the inner product. Vectors have ``size`` numbers and one more: 1 for sessions, the lead of an item for all sessions.

    Sessions and items are dealt in ``blocks`` parts each (default: as many as the rows ask for); in a stratum every part of the sessions meets one part of the
    items, where negatives are drawn too. Equal for equal seeds, whatever the partitioning.
    """
    rows = interactions.select(F.col("session").cast("long").alias("session"), F.col("aid").cast("long").alias("aid")).distinct()
    blocks = _enough(rows, blocks, "session", "aid")
    rows = rows.withColumn("ub", _block_of("session", blocks, seed)).withColumn("ib", _block_of("aid", blocks, seed + 1))
    pairs = rows.groupBy("ub", "ib").agg(F.sort_array(F.collect_list(F.struct("session", "aid"))).alias("pairs"))
    pairs = staged(pairs.select("ub", "ib", F.col("pairs.session").alias("left"), F.col("pairs.aid").alias("right")))
    size += 1
    users, items = _packed(rows, "session", blocks, size, seed, last=1.0), _packed(rows, "aid", blocks, size, seed + 1, last=0.0)
    for turn in range(epochs * blocks):
        def kernel(one: _Block, two: _Block, r, turn: int = turn) -> None:
            _warp_step(one, two, one.places(np.asarray(r.left)), two.places(np.asarray(r.right)), np.random.default_rng([seed, turn, r.ub]), trials, batch, reg)

        met = F.pmod(F.col("ub") + F.lit(turn % blocks), F.lit(blocks)) == F.col("ib")
        users, items = _stratum(pairs.where(met), users, items, kernel, size, step)
    return _unpacked(users, "session", size), _unpacked(items, "aid", size)


def _stratum(pairs: DataFrame, one: DataFrame, two: DataFrame, kernel: Callable, size: int, step: float, shared: bool = False) -> tuple[DataFrame, DataFrame]:
    """One side and the other after a stratum: blocks that met are moved, the others stay. ``shared``: both are one table."""
    x = one.select(F.col("block").alias("ub"), *[F.col(c).alias(f"{c}1") for c in ("ids", "vectors", "sums")])
    y = two.select(F.col("block").alias("ib"), *[F.col(c).alias(f"{c}2") for c in ("ids", "vectors", "sums")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                a = _Block(r.ids1, r.vectors1, r.sums1, size, step)
                b = a if shared and r.ub == r.ib else _Block(r.ids2, r.vectors2, r.sums2, size, step)
                kernel(a, b, r)
                sides = [(0, r.ub, *a.packed())] + ([] if b is a else [(1, r.ib, *b.packed())])
                yield pd.DataFrame(sides, columns=["side", "block", "ids", "vectors", "sums"])

    met = pairs.join(x, "ub").join(y, "ib")
    moved = staged(met.mapInPandas(run, "side int, " + _SIDE))
    out = []
    for side, old in ((0, one), (1, two)):
        new = moved if shared else moved.where(F.col("side") == side)
        out.append(staged(new.drop("side").unionByName(old.join(new.select("block"), "block", "left_anti"))))
        if shared:
            out.append(out[0])
            break
    drop_staged(*({id(t): t for t in (one, two, moved)}.values()))
    return out[0], out[1]


# ---- next items in one shared table --------------------------------------------------------


def _rounds(blocks: int) -> list[list[tuple[int, int]]]:
    """Every pair of blocks once, and each block with itself, in rounds without a block in common (blocks is even)."""
    out, seats = [[(b, b) for b in range(blocks)]], list(range(blocks))
    for _ in range(blocks - 1):
        out.append([tuple(sorted((seats[i], seats[-1 - i]))) for i in range(blocks // 2)])
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def _pair_step(a: _Block, b: _Block, left: np.ndarray, right: np.ndarray, weight: np.ndarray, rng: np.random.Generator, batch: int) -> None:
    """Logistic loss of true pairs and of pairs with the partner of another row of the batch."""
    order = rng.permutation(len(left))
    for at in range(0, len(order), batch):
        own = order[at : at + batch]
        l, r = left[own], right[own]
        for partner, truth in ((r, 1.0), (r[rng.permutation(len(r))], 0.0)):
            vl, vr = a.v[l], b.v[partner]
            g = (1 / (1 + np.exp(-np.einsum("nd,nd->n", vl, vr))) - truth)[:, None] * weight[own, None]
            a.move(l, g * vr)
            b.move(partner, g * vl)


def pair_vectors(pairs: DataFrame, size: int = 32, epochs: int = 10, blocks: int | None = None, step: float = 0.05, seed: int = 42, batch: int = 256, valid: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """Item vectors (aid, vector) from pairs (aid, aid_next, n): both sides of a pair are rows of one table, and ``n`` weighs it.

    True pairs should have a positive inner product and pairs with a partner from elsewhere in the batch a negative
    one. Block i meets block j in one round for both directions of pairs, so the two sides move the same rows. With
    ``valid`` the share of its pairs, true ones and as many wrong ones (partners shifted in hash order), that falls on the right side is
    returned for every epoch.
    """
    blocks = _enough(pairs, blocks, "aid", "aid_next")
    rows = pairs.select(F.col("aid").cast("long").alias("aid"), F.col("aid_next").cast("long").alias("aid_next"), F.col("n").cast("double").alias("n"))
    rows = rows.withColumn("x", _block_of("aid", blocks, seed)).withColumn("y", _block_of("aid_next", blocks, seed))
    flip = F.col("x") > F.col("y")
    rows = rows.select(F.least("x", "y").alias("ub"), F.greatest("x", "y").alias("ib"), F.when(flip, F.col("aid_next")).otherwise(F.col("aid")).alias("l"), F.when(flip, F.col("aid")).otherwise(F.col("aid_next")).alias("r"), "n")
    dealt = rows.groupBy("ub", "ib").agg(F.sort_array(F.collect_list(F.struct("l", "r", "n"))).alias("pairs"))
    dealt = staged(dealt.select("ub", "ib", F.col("pairs.l").alias("left"), F.col("pairs.r").alias("right"), F.col("pairs.n").alias("weight")))
    table = _packed(pairs.select(F.explode(F.array("aid", "aid_next")).alias("aid")), "aid", blocks, size, seed)
    curve = []
    for epoch in range(epochs):
        for n, meeting in enumerate(_rounds(blocks)):
            def kernel(one: _Block, two: _Block, r, turn: int = epoch * blocks + n) -> None:
                left, right, weight = (np.asarray(x) for x in (r.left, r.right, r.weight))
                _pair_step(one, two, one.places(left), two.places(right), weight, np.random.default_rng([seed, turn, r.ub]), batch)

            chosen = F.concat_ws(":", "ub", "ib").isin([f"{i}:{j}" for i, j in meeting])
            table, _ = _stratum(dealt.where(chosen), table, table, kernel, size, step, shared=True)
        if valid is not None:
            curve.append(_right_side(_unpacked(table, "aid", size), valid))
    return _unpacked(table, "aid", size), curve


def _right_side(vectors: DataFrame, valid: DataFrame) -> float:
    """Share of rows (aid, aid_next, aid_wrong) on the right side of zero, each once as true and once as wrong."""
    v = staged(vectors)
    rows = valid
    for c in ("aid", "aid_next", "aid_wrong"):
        rows = rows.join(v.select(F.col("aid").alias(c), F.col(VECTOR).alias(f"v_{c}")), c)
    product = lambda c: F.aggregate(F.zip_with("v_aid", f"v_{c}", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    good = (product("aid_next") > 0).cast("int") + (product("aid_wrong") < 0).cast("int")
    return rows.agg(F.sum(good) / (2 * F.count(F.lit(1)))).first()[0]


def next_item_vectors(events: DataFrame, size: int = 32, epochs: int = 10, **settings) -> DataFrame:
    """``pair_vectors`` of the moves of a log, each weighed by how often it was made."""
    return pair_vectors(staged(move_counts(events).withColumnRenamed("moves", "n")), size, epochs, **settings)[0]
