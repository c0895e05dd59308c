"""Expressions over embedding columns (array of float)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow list column of equal-length vectors as a 2-d double array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def normalise(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def angular(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances sqrt(2 (1 - cos)) between rows of two unit matrices.

    Squares are cut to 12 places, so that the distance of a vector to itself is 0 and not the root
    of a rounding error.
    """
    return np.sqrt(np.maximum(0.0, np.round(2.0 - 2.0 * (a @ b.T), 12)))


def dot(left: Column, right: Column) -> Column:
    """Row-wise inner product, Arrow batches in and out."""

    @F.arrow_udf("double")
    def row_dot(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array(np.einsum("ij,ij->i", matrix(a), matrix(b)))

    return row_dot(left, right)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0).cast("double") / (F.lit(1.0).cast("double") + F.exp(-x))


def wide(vector: Column, size: int, prefix: str) -> list[Column]:
    return [vector[i].alias(f"{prefix}{i}") for i in range(size)]
