"""Exact top-k by inner product: vectors by falling length, partial sums in rotated coordinates.

All vectors are rotated to the axes of their largest variation (from the singular value decomposition, by way of
the summed products of the coordinates). A score is then added up a few axes at a time; what is still to come is at
most the product of the lengths of the two rests (Cauchy-Schwarz), and a pair whose best case lies below the
query's k-th score so far is dropped. The table is stored by falling length. The longest vectors give each query
a first k-th score; vectors that are too short to reach it are not even read. Rotated sums only prune: what is
left is scored again in whole numbers.

Queries are worked on in blocks of bounded size that are sent to the tasks; each block is a scan, and a task passes
on k rows for each query at most. No vector is shuffled for a search.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlens.llm.common import list_array, slices
from sessionlens.operators.ranking import global_index
from sessionlens.sources.sinks import staged

SCALE = 1024
QUERY_BLOCK = 4096  # queries sent to the tasks at a time: 2 MB at 64 axes
HEAD = 4096  # longest vectors that give the first k-th scores
AXES = 16  # axes added at a time
TILE = 1 << 22  # pairs looked at together
_VECTORS = "vec_id long, dim int, norm double, v array<long>"
_HITS = "query long, vec_id long, score long"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(1024 x) of the vectors that are whole and finite."""
    for batch in slices(batches, 4096):
        ids, kept, out = batch.column("vec_id").to_pylist(), [], []
        for vec_id, x in zip(ids, batch.column("v")):
            if vec_id is None or not x.is_valid or x.values.null_count:
                continue
            x = x.values.to_numpy(zero_copy_only=False).astype(float)
            if np.isfinite(x).all():
                kept.append(vec_id)
                out.append(np.floor(SCALE * x).astype(np.int64))
        if kept:
            norms = [float(np.linalg.norm(x.astype(float))) for x in out]
            dims = pa.array([len(x) for x in out], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), dims, pa.array(norms), list_array(out)], ["vec_id", "dim", "norm", "v"])


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    column = batch.column("v")
    return np.asarray(column.flatten(), np.int64).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            x = _matrix(batch.filter(pa.array(dims == dim)), int(dim)).astype(float)
            sums[int(dim)] = sums.get(int(dim), 0.0) + x.T @ x
    for dim, total in sums.items():
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(i.size, dim, np.int32)), pa.array(i), pa.array(j), pa.array(total.ravel())], ["dim", "i", "j", "total"])


class _Block:
    """Queries of one length and rotation, with the scores that a hit has to reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray, k: int):
        self.ids, self.vectors, self.axes, self.k = ids, vectors, axes, k
        self.least = np.full(len(ids), -np.inf)
        self.rotated = vectors @ axes
        self.norms = np.sqrt((self.rotated**2).sum(1))

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of these rows for each query, as far as they reach the least score."""
        dim, least = self.vectors.shape[1], self.least.copy()
        best = np.empty((0, 3), np.int64)  # query, vec_id, score
        for batch in slices(batches, max(64, TILE // len(self.ids))):
            ids, x = batch.column("vec_id").to_numpy(), _matrix(batch, dim)
            rows, queries = self._reach(x @ self.axes, least)
            own = ids[rows] == self.ids[queries]
            rows, queries = rows[~own], queries[~own]
            scores = np.empty(len(rows), np.int64)
            for at in range(0, len(rows), 1 << 16):
                part = slice(at, at + (1 << 16))
                scores[part] = np.einsum("ij,ij->i", x[rows[part]], self.vectors[queries[part]])
            reach = scores >= least[queries]
            best = self._best(np.r_[best, np.c_[queries, ids[rows], scores][reach]])
            full = np.flatnonzero(np.bincount(best[:, 0], minlength=len(least)) >= self.k)
            last = np.searchsorted(best[:, 0], full, "right") - 1
            least[full] = np.maximum(least[full], best[last, 2])
        if len(best):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.T.copy()], ["query", "vec_id", "score"])

    def _best(self, hits: np.ndarray) -> np.ndarray:
        hits = hits[np.lexsort((hits[:, 1], -hits[:, 2], hits[:, 0]))]
        first = np.searchsorted(hits[:, 0], hits[:, 0])
        return hits[np.arange(len(hits)) - first < self.k]

    def _reach(self, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, query) whose bound never fell below the least score."""
        norms = np.sqrt((x**2).sum(1))
        slack = 1e-9 * (1 + norms[:, None] * self.norms)  # of rounding
        longest = norms[:, None] * self.norms
        rows, queries = np.nonzero(longest + slack >= least)
        done, sums, dim = 0, np.zeros(len(rows)), x.shape[1]
        dense = np.zeros((len(x), len(self.ids))) if len(rows) else None
        while done < dim and len(rows):
            to = min(dim, done + AXES)
            if dense is not None and len(rows) * 4 > dense.size:
                dense += x[:, done:to] @ self.rotated[:, done:to].T
                sums = dense[rows, queries]
            else:
                dense = None
                sums = np.concatenate([sums[s : s + 65536] + np.einsum("ij,ij->i", x[rows[s : s + 65536], done:to], self.rotated[queries[s : s + 65536], done:to]) for s in range(0, len(rows), 65536)])
            rest_x, rest_q = np.sqrt((x[:, to:] ** 2).sum(1)), np.sqrt((self.rotated[:, to:] ** 2).sum(1))
            keep = sums + rest_x[rows] * rest_q[queries] + slack[rows, queries] >= least[queries]
            rows, queries, sums, done = rows[keep], queries[keep], sums[keep], to
        return rows, queries


def top_k(vectors: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its ``k`` best other rows.

    A component x counts as floor(1024 x); a score is the whole-number inner product, which must fit 64 bits. Ties
    go to the smaller id. Vectors that are null, hold null or infinite components or have no id take no part.
    Vectors are compared with those of the same length only. Rows with the query's id are its own. Repeated rows
    are candidates each, but one query. An empty table gives an empty result. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    only = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    whole = only.mapInArrow(_whole, _VECTORS)
    by_length = [F.col("dim"), F.desc("norm"), F.col("vec_id")]
    table = staged(whole.repartitionByRange(*by_length).sortWithinPartitions(*by_length))
    products = table.mapInArrow(_products, "dim int, i long, j long, total double").groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).toPandas()
    axes = {}
    for dim, part in products.groupby("dim"):
        total = np.zeros((dim, dim))
        total[part["i"], part["j"]] = part["total"]
        axes[int(dim)] = np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]

    queries = table.where(F.col("vec_id") % every == 0).select("vec_id", "dim", "v").distinct()
    queries = staged(global_index(queries, F.col("dim"), F.col("vec_id"), F.col("v")).withColumn("block", F.floor(F.col("index") / QUERY_BLOCK)))
    blocks = queries.select("dim", "block").distinct().orderBy("dim", "block").collect()  # a row for thousands of queries
    found = []
    for dim, number in blocks:
        rows = queries.where((F.col("dim") == dim) & (F.col("block") == number)).orderBy("index").select("vec_id", "index", "v").toPandas()
        block = _Block(rows["vec_id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(np.int64).reshape(len(rows), dim), axes.get(dim, np.zeros((dim, dim))), k)
        same = table.where(F.col("dim") == dim)
        head = same.orderBy(F.desc("norm"), "vec_id").limit(HEAD).repartition(8)
        first = head.mapInArrow(block.search, _HITS).toPandas().sort_values(["query", "score"], ascending=[True, False])
        kth = first.groupby("query").nth(k - 1)
        block.least[kth["query"].to_numpy(np.int64)] = kth["score"].to_numpy(float)
        shortest = float((block.least / np.maximum(block.norms, 1e-300)).min())
        hits = same.where(F.col("norm") >= shortest * (1 - 1e-9) - 1e-9).mapInArrow(block.search, _HITS)
        hits = hits.withColumn("at", F.col("query") + int(rows["index"].iloc[0]))
        found.append(hits.join(F.broadcast(queries.where((F.col("dim") == dim) & (F.col("block") == number)).select(F.col("index").alias("at"), F.col("vec_id").alias("query_id"))), "at"))  # a block
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("at").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
