"""Nearest items by angular distance sqrt(2 (1 - cos))."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.config import DEFAULTS
from sessionlens.functions.columns import stable_hash
from sessionlens.functions.vectors import angular, matrix, normalise
from sessionlens.operators.blocks import block_join
from sessionlens.operators.ranking import smallest, top_n
from sessionlens.sources.sinks import staged

_OUT = "aid_x long, aid_y long, dist double"


def _nearest_kernel(k: int):
    """Best ``k`` of a right block for every row of a left block; ties go to the lower id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column("left")[i].values, batch.column("right")[i].values
                xs = left.field("aid").to_numpy(zero_copy_only=False)
                ys = right.field("aid").to_numpy(zero_copy_only=False)
                dist = np.round(
                    angular(normalise(matrix(left.field("vector"))), normalise(matrix(right.field("vector")))), 6
                )
                kth = np.partition(dist, min(k, len(ys)) - 1, axis=1)[:, min(k, len(ys)) - 1]
                row, col = np.nonzero(dist <= kth[:, None])
                order = np.lexsort((ys[col], dist[row, col], row))
                row, col = row[order], col[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[place < k], col[place < k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(xs[row]), pa.array(ys[col]), pa.array(dist[row, col])], ["aid_x", "aid_y", "dist"]
                )

    return run


def _nearest(queries: DataFrame, vectors: DataFrame, keys: list[str], k: int, size: int) -> DataFrame:
    cols = ["aid", "vector"]
    met = block_join(queries, vectors, keys, "aid", cols, cols, size)
    return met.select("left", "right").mapInArrow(_nearest_kernel(k), _OUT)


# ---- grid ----------------------------------------------------------------------------------

LOTS, LANES = 16, 4  # parts of the queries and of the vectors: a vector travels LOTS times, a query LANES times
LOT_LEAST, LOT_MOST = 256, 1 << 16  # queries of a lot, which a task holds
STRIP = 1024  # queries compared at a time


def grid_size(queries: int, vectors: int) -> tuple[int, int]:
    """Lots and lanes: the same number from a few thousand rows on, so that what is shuffled grows as the tables do.

    From LOTS x LOT_MOST queries on there are more lots, as a task holds the queries of its lot. Vectors stream by.
    """
    lots = max(min(LOTS, math.ceil(queries / LOT_LEAST)), math.ceil(queries / LOT_MOST), 1)
    return lots, max(1, min(LANES, math.ceil(vectors / LOT_LEAST)))


class _Lot:
    """The queries of a task with the ``k`` nearest of each so far."""

    def __init__(self, tables: list[pa.Table], k: int):
        table = pa.concat_tables(tables)
        self.aids = table.column("aid").to_numpy()
        self.unit = normalise(matrix(table.column("vector")))
        self.dist = np.full((len(self.aids), k), np.inf)
        self.near = np.zeros((len(self.aids), k), np.int64)

    def offer(self, rows: np.ndarray, ys: np.ndarray, unit: np.ndarray) -> None:
        """Vectors that the queries ``rows`` look at. Only those that may come before a k-th so far are ranked."""
        k = self.dist.shape[1]
        for at in range(0, len(rows), STRIP):
            own = rows[at : at + STRIP]
            square = 2.0 - 2.0 * (self.unit[own] @ unit.T)
            most = (self.dist[own, -1] + 1e-6) ** 2 + 1e-11  # more than rounding can hide
            if len(ys) > k and not np.isfinite(most).all():
                most = np.minimum(most, np.partition(square, k - 1, axis=1)[:, k - 1] + 5e-6)
            row, col = np.nonzero(square <= most[:, None])
            if not len(row):
                continue
            far = np.round(np.sqrt(np.maximum(0.0, np.round(square[row, col], 12))), 6)
            hit, row = np.unique(row, return_inverse=True)
            held = own[hit]
            dist = np.concatenate([self.dist[held].ravel(), far])
            near = np.concatenate([self.near[held].ravel(), ys[col]])
            row = np.concatenate([np.repeat(np.arange(len(held)), k), row])
            order = np.lexsort((near, dist, row))
            starts = np.searchsorted(row[order], np.arange(len(held)))
            best = order[starts[:, None] + np.arange(k)]  # a row has k at least
            self.dist[held], self.near[held] = dist[best], near[best]

    def result(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.aids), 4 * STRIP):
            row, col = np.nonzero(np.isfinite(self.dist[at : at + 4 * STRIP]))
            row = row + at
            arrays = [pa.array(self.aids[row]), pa.array(self.near[row, col]), pa.array(self.dist[row, col])]
            yield pa.RecordBatch.from_arrays(arrays, ["aid_x", "aid_y", "dist"])


def _meeting_kernel(k: int, block: int, looks=None):
    """Best ``k`` for each query of a task among the vectors that stream by after the queries.

    ``looks`` says of the queries' table which of its rows look at which cell, as a function of the cell; else all look at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asked, lot, wanted = None, [], None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            cuts = np.flatnonzero(np.any(np.diff(np.array([batch.column(c).to_numpy() for c in ("task", "side", "cell")]), axis=1), axis=0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), table.num_rows]):
                run_ = table.slice(start, stop - start)
                now, side, cell = (run_.column(c)[0].as_py() for c in ("task", "side", "cell"))
                if now != task:
                    if lot is not None:
                        yield from lot.result()
                    task, asked, lot = now, [], None
                if side == 0:
                    asked.append(run_)
                    continue
                if not asked:
                    continue  # nobody looks here
                if lot is None:
                    lot = _Lot(asked, k)
                    wanted = looks(pa.concat_tables(asked)) if looks else (lambda _, rows=np.arange(len(lot.aids)): rows)
                rows = wanted(cell)
                for at in range(0, run_.num_rows if len(rows) else 0, block):
                    part = run_.slice(at, block)
                    lot.offer(rows, part.column("aid").to_numpy(), normalise(matrix(part.column("vector"))))
        if lot is not None:
            yield from lot.result()

    return run


def _met(asked: DataFrame, offered: DataFrame, lots: int, lanes: int, kernel) -> DataFrame:
    """Queries (lot, cell, aid, vector and more) and vectors (lots, a list, cell, aid, vector) sent to the tasks (lot, lane).

    A task gets its queries first, by cell, and then its vectors, by cell.
    """
    task = F.col("lot") * lanes + F.col("lane")
    every = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    left = asked.withColumn("lane", every).withColumn("task", task).withColumn("side", F.lit(0)).drop("lot", "lane")
    lane = F.pmod(F.xxhash64("aid"), F.lit(lanes)).cast("int")
    right = offered.select(F.explode("lots").alias("lot"), lane.alias("lane"), "cell", "aid", "vector")
    right = right.withColumn("task", task).withColumn("side", F.lit(1)).drop("lot", "lane")
    both = left.unionByName(right, allowMissingColumns=True)
    dealt = both.repartitionById(lots * lanes, "task").sortWithinPartitions("task", "side", "cell")
    return dealt.mapInArrow(kernel, _OUT)


def item_knn(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = DEFAULTS.neighbours,
    block: int = 2048,
) -> DataFrame:
    """Exact neighbours (aid_x, aid_y, dist, n) of the items in ``queries`` (default: all items).

    An item is its own nearest neighbour. A task holds the queries of its lot and at most k rows for each; the vectors of its
    lane stream by, ``block`` at a time.
    """
    vectors = vectors.select("aid", "vector")
    wanted = vectors if queries is None else vectors.join(queries.select("aid").distinct(), "aid")
    lots, lanes = grid_size(wanted.count(), vectors.count())
    one = F.lit(0).alias("cell")
    asked = wanted.select(F.pmod(F.xxhash64("aid"), F.lit(lots)).cast("int").alias("lot"), one, "aid", "vector")
    offered = vectors.select(F.sequence(F.lit(0), F.lit(lots - 1)).alias("lots"), one, "aid", "vector")
    near = _met(asked, offered, lots, lanes, _meeting_kernel(k, block))
    return top_n(near, ["aid_x"], [F.asc("dist"), F.asc("aid_y")], k, out="n")


def plane_signs(size: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """Random planes of components 1 and -1 (size, tables, bits), from md5 so that SQL can draw the same."""
    even = [
        int(hashlib.md5(f"{seed}:{t}:{b}:{d}".encode()).hexdigest()[0], 16) % 2 == 0
        for d in range(size)
        for t in range(tables)
        for b in range(bits)
    ]
    return np.where(even, 1.0, -1.0).reshape(size, tables, bits)


def _signature_kernel(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            rows = matrix(batch.column("vector"))
            if not len(rows):
                continue
            planes = plane_signs(rows.shape[1], tables, bits, seed) if planes is None else planes
            codes = (np.einsum("nd,dtb->ntb", rows, planes) > 0) @ (1 << np.arange(bits))
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("aid"),
                        batch.column("vector").cast(pa.list_(pa.float32())),
                        pa.array(np.full(len(rows), t, dtype=np.int32)),
                        pa.array(codes[:, t].astype(np.int64)),
                    ],
                    ["aid", "vector", "tbl", "code"],
                )

    return run


def lsh_bits(items: int, per_bucket: int) -> int:
    """Planes of a table, so that a bucket holds about ``per_bucket`` items whatever the catalogue."""
    return max(1, math.ceil(math.log2(max(2, items) / per_bucket)))


def lsh_tables(bits: int, recall: float, cosine: float) -> int:
    """Tables in which two items at ``cosine`` share the side of all ``bits`` planes once with odds of ``recall``."""
    shared = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - shared))


def item_knn_lsh(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = DEFAULTS.neighbours,
    per_bucket: int = 256,
    tables: int = 12,
    block: int = 2048,
    seed: int = 7,
    recall: float = 0.9,
    cosine: float = 0.7,
) -> DataFrame:
    """Neighbours (aid_x, aid_y, dist, n) of the items in ``queries`` (default: all items): exact search among
    the items that share the side of all planes in one of several tables.

    Buckets grow in number with the catalogue, not in size; crowded ones are split in blocks, not cut. More planes
    are shared by fewer neighbours, so tables grow too, from ``tables`` on, as far as neighbours at ``cosine`` are
    to be found with odds of ``recall`` (12 up to 8,192 items, 101 for 2 million). Nearer ones are found more often.
    """
    schema = "aid long, vector array<float>, tbl int, code long"
    bits = lsh_bits(vectors.count(), per_bucket)
    tables = max(tables, lsh_tables(bits, recall, cosine))
    coded = staged(vectors.select("aid", "vector").mapInArrow(_signature_kernel(bits, tables, seed), schema))
    wanted = coded if queries is None else coded.join(queries.select("aid").distinct(), "aid", "left_semi")
    near = _nearest(wanted, coded, ["tbl", "code"], k, block).distinct()
    return top_n(near, ["aid_x"], [F.asc("dist"), F.asc("aid_y")], k, out="n")


# ---- cells ---------------------------------------------------------------------------------

CELLS_MOST = 4096  # centres in a task: 4096 x 64 floats are a megabyte
CELL_SAMPLE = 32  # vectors for each centre that the centres are drawn from, on the driver
SLACK = 1e-5  # distances are rounded to six places, their squares to twelve
NEAREST = 4  # cells of a query that are looked at first
_CELL = "aid long, vector array<float>, cell int, gap double, near array<int>"


def cell_centres(vectors: DataFrame, items: int, passes: int = 8) -> np.ndarray:
    """Unit centres of about sqrt(items) cells, by k-means over a bounded sample drawn by hash."""
    cells = max(1, min(CELLS_MOST, round(math.sqrt(items))))
    rows = smallest(vectors.select("aid", "vector"), stable_hash(F.col("aid"), seed=11), [F.col("aid")], cells * CELL_SAMPLE)
    table = rows.toArrow().sort_by("aid")
    points = np.unique(normalise(np.concatenate([matrix(c) for c in table.column("vector").chunks])).astype(np.float32), axis=0)
    centres = points[np.random.default_rng(0).permutation(len(points))[:cells]]
    for _ in range(passes):
        own = np.concatenate([np.argmax(points[at : at + 8192] @ centres.T, axis=1) for at in range(0, len(points), 8192)])
        order = np.argsort(own, kind="stable")
        filled, starts = np.unique(own[order], return_index=True)
        centres[filled] = np.add.reduceat(points[order], starts, axis=0)
        centres = normalise(centres).astype(np.float32)
    return side_by_side(normalise(centres.astype(np.float64)))


def side_by_side(centres: np.ndarray) -> np.ndarray:
    """The centres in an order in which neighbours stand together: halved along the widest axis, and so on."""
    done, todo = [], [np.arange(len(centres))]
    while todo:
        own = todo.pop()
        if len(own) <= 2:
            done += own.tolist()
            continue
        middle = centres[own] - centres[own].mean(axis=0)
        axis = np.linalg.svd(middle, full_matrices=False)[2][0]
        own = own[np.argsort(middle @ axis, kind="stable")]
        todo += [own[len(own) // 2 :], own[: len(own) // 2]]
    return centres[done]


def _cell_kernel(centres: np.ndarray):
    """The nearest centre of each vector, how far it is, and the centres that are nearest after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, STRIP) for whole in batches for at in range(0, whole.num_rows, STRIP)):
            far = angular(normalise(matrix(batch.column("vector"))), centres)
            near = np.argsort(far, axis=1, kind="stable")[:, :NEAREST]
            cell = near[:, 0]
            lists = pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("aid"), batch.column("vector").cast(pa.list_(pa.float32())), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell]), lists],
                ["aid", "vector", "cell", "gap", "near"],
            )

    return run


def _looks(table: pa.Table, centres: np.ndarray, radius: np.ndarray, nearest: int, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each own cell among the queries ``table``, the cells that its queries look at: (own cells, marks).

    The ``nearest`` cells of each query, NEAREST at most of which were looked up when the cells were made; with ``bounded`` all
    but these, as far as the triangle inequality leaves room for a member nearer than the query's k-th so far.
    """
    own = table.column("cell").to_numpy()
    cells, group = np.unique(own, return_inverse=True)
    first = np.array(table.column("near").to_pylist(), np.int64).reshape(len(own), -1)[:, :nearest]
    seen = np.zeros((len(cells), len(centres)), bool)
    seen[group[:, None], first] = True
    if not bounded:
        return cells, seen
    marks = np.zeros_like(seen)
    least = table.column("kth").to_numpy()
    order = np.argsort(group, kind="stable")
    sorted_ = table.column("vector").take(order)
    for at in range(0, len(own), STRIP):
        some = order[at : at + STRIP]
        far = angular(normalise(matrix(sorted_.slice(at, STRIP))), centres)
        kth = least[some]
        wanted = (far - radius <= kth[:, None] + SLACK) | np.isnan(kth)[:, None]
        if nearest < len(centres):
            wanted &= np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1) < nearest
        filled, starts = np.unique(group[some], return_index=True)
        marks[filled] |= np.logical_or.reduceat(wanted, starts, axis=0)
    return cells, marks & ~seen


class Cells:
    """An inverted file: every vector once, under its nearest centre, with each cell's radius."""

    def __init__(self, vectors: DataFrame, block: int = 2048):
        self.block = block
        self.items = vectors.count()
        self.centres = cell_centres(vectors, self.items) if self.items else np.zeros((0, 1))
        self.rows = staged(vectors.select("aid", "vector").mapInArrow(_cell_kernel(self.centres), _CELL))
        self.radius = np.zeros(len(self.centres))
        for r in self.rows.groupBy("cell").agg(F.max("gap").alias("gap")).collect():  # a row for each cell
            self.radius[r["cell"]] = r["gap"]

    def lots_of(self, queries: DataFrame) -> tuple[DataFrame, int, int]:
        """``queries`` with the ``lot`` of each: cells that stand together share one, a cell with many queries has several."""
        counts = {r["cell"]: r["count"] for r in queries.groupBy("cell").count().collect()}  # a row for each cell
        lots, lanes = grid_size(sum(counts.values()), self.items)
        size = math.ceil(max(1, sum(counts.values())) / lots)
        deal, lot, filled = [], 0, 0
        for cell, n in sorted(counts.items()):
            parts = math.ceil(n / size)
            if filled and (parts > 1 or filled + n > size):
                lot, filled = lot + 1, 0
            deal.append((cell, lot, parts))
            filled += n
            if parts > 1:
                lot, filled = lot + parts, 0
        table = queries.sparkSession.createDataFrame(deal, "cell int, _lot int, _parts int")
        place = F.col("_lot") + F.pmod(F.xxhash64("aid"), F.col("_parts")).cast("int")
        return queries.join(F.broadcast(table), "cell").withColumn("lot", place).drop("_lot", "_parts"), lot + 1, lanes  # CELLS_MOST rows

    def looked(self, asked: DataFrame, lots: int, lanes: int, k: int, nearest: int, bounded: bool) -> DataFrame:
        """The ``k`` nearest of each query of ``asked`` (with its lot) in the cells that its lot's queries of its cell look at."""
        centres, radius = self.centres, self.radius

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                out = set()
                for lot in np.unique(batch.column("lot").to_numpy()).tolist():
                    cells, marks = _looks(table.filter(pc.equal(table.column("lot"), lot)), centres, radius, nearest, bounded)
                    out |= {(lot, c) for c in np.flatnonzero(marks.any(axis=0)).tolist()}
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([c for _, c in out], pa.int32())], ["lot", "cell"])

        def looks(table: pa.Table):
            own = table.column("cell").to_numpy()
            cells, marks = _looks(table, centres, radius, nearest, bounded)
            group = np.searchsorted(cells, own)
            return lambda cell: np.flatnonzero(marks[group, cell])

        sent = asked.mapInArrow(probe, "lot int, cell int").distinct().groupBy("cell").agg(F.collect_list("lot").alias("lots"))
        offered = self.rows.join(F.broadcast(sent), "cell").select("lots", "cell", "aid", "vector")  # a row for each cell
        return _met(asked, offered, lots, lanes, _meeting_kernel(k, self.block, looks))

    def search(self, queries: DataFrame, k: int, first: int = NEAREST, probes: int | None = None) -> DataFrame:
        """The ``k`` nearest of the rows ``queries`` of this file: exactly, or among ``probes`` cells of each at most.

        Vectors meet queries on the grid: a vector goes once to each lot that has to look at its cell.
        """
        if not self.items:
            return self.rows.select(F.col("aid").alias("aid_x"), F.col("aid").alias("aid_y"), F.col("gap").alias("dist"), F.lit(1).cast("long").alias("n"))
        most = len(self.centres) if probes is None else min(probes, len(self.centres))
        first = min(first, most, NEAREST)
        order = [F.asc("dist"), F.asc("aid_y")]
        asked, lots, lanes = self.lots_of(queries.select("aid", "vector", "cell", "near"))
        asked = asked.withColumn("near", F.slice("near", 1, first))
        found = staged(top_n(self.looked(asked, lots, lanes, k, first, False), ["aid_x"], order, k, out="n"))
        if first == len(self.centres):
            return found
        kth = found.where(F.col("n") == k).select(F.col("aid_x").alias("aid"), F.col("dist").alias("kth"))
        again = staged(asked.join(kth, "aid", "left"))
        both = found.drop("n").unionByName(self.looked(again, lots, lanes, k, most, True)).distinct()
        return top_n(both, ["aid_x"], order, k, out="n")

    def probes_for(self, recall: float, k: int, sample: int = 200) -> int:
        """Cells to look at so that a share ``recall`` of the neighbours of ``sample`` queries lies in them, by exact search of these."""
        drawn = smallest(self.rows.select("aid"), stable_hash(F.col("aid"), seed=13), [F.col("aid")], sample)
        some = staged(self.rows.join(drawn, "aid", "left_semi"))
        exact = item_knn(self.rows.select("aid", "vector"), some.select("aid"), k, self.block)
        cells = self.rows.select(F.col("aid").alias("aid_y"), "cell")
        homes = {}
        for r in exact.join(cells, "aid_y").select("aid_x", "cell").collect():  # sample x k rows
            homes.setdefault(r["aid_x"], []).append(r["cell"])
        places = []
        for r in some.select("aid", "vector").collect():
            far = angular(normalise(np.array([r["vector"]], np.float64)), self.centres)[0]
            places += np.argsort(np.argsort(far, kind="stable"))[homes.get(r["aid"], [])].tolist()
        return 1 + sorted(places)[min(len(places) - 1, math.ceil(recall * len(places)))] if places else 1


def item_knn_cells(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = DEFAULTS.neighbours,
    block: int = 2048,
    recall: float | None = None,
) -> DataFrame:
    """Neighbours (aid_x, aid_y, dist, n) of the items in ``queries`` (default: all items), through an inverted file.

    A vector is stored once, whatever the catalogue. A query looks at its nearest cells, and then at all whose centre
    and radius leave room for something nearer than its k-th: the result is exact. With ``recall`` it looks at as many of
    its nearest cells as hold that share of the neighbours of a sample of queries, and no further.
    """
    cells = Cells(vectors, block)
    wanted = cells.rows if queries is None else cells.rows.join(queries.select("aid").distinct(), "aid", "left_semi")
    probes = cells.probes_for(recall, k) if recall is not None and cells.items else None
    return cells.search(wanted, k, probes=probes)
