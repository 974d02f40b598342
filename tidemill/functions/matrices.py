"""Matrices: small dense ones with numpy on the driver, large ones as tables of (i, j, v), and arrays of arrays in columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ComputeError, StatError

# -- dense, on the driver ---------------------------------------------------------


def matrix(rows) -> np.ndarray:
    """A dense matrix of doubles from rows of equal length."""
    try:
        out = np.array(rows, dtype=float)
    except ValueError as e:
        raise ComputeError("C0205", "rows differ in length") from e
    return out if out.ndim == 2 else out.reshape(1, -1)


def solve(a, b) -> np.ndarray:
    a = matrix(a)
    if np.linalg.matrix_rank(a) < len(a):
        raise StatError("S0101", "the matrix is singular")
    return np.linalg.solve(a, np.asarray(b, float))


def qr(a) -> tuple[np.ndarray, np.ndarray]:
    """Thin factors, with a positive diagonal of R."""
    q, r = np.linalg.qr(matrix(a))
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * sign, r * sign[:, None]


def cholesky(a) -> np.ndarray:
    try:
        return np.linalg.cholesky(matrix(a))
    except np.linalg.LinAlgError as e:
        raise StatError("S0101", "the matrix is not positive definite") from e


def svd(a) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thin U, singular values, V."""
    u, s, vt = np.linalg.svd(matrix(a), full_matrices=False)
    return u, s, vt.T


def eigen(a) -> tuple[np.ndarray, np.ndarray]:
    """Values, largest first, and vectors of a symmetric matrix."""
    values, vectors = np.linalg.eigh(matrix(a))
    return values[::-1], vectors[:, ::-1]


def philox(seed: int, n: int, kind: str = "uniform") -> np.ndarray:
    """Counter-based draws: the i-th depends on seed and i alone."""
    rng = np.random.Generator(np.random.Philox(key=seed))
    return rng.random(n) if kind == "uniform" else rng.standard_normal(n)


# -- distributed, as (i, j, v) -------------------------------------------------------


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two tables of entries: a join on the inner index, then sums; absent entries are zero."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("jj"), F.col("v").alias("w"))
    both = a.select("i", F.col("j").alias("k"), "v").join(right, "k")
    return both.groupBy("i", F.col("jj").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def add(a: DataFrame, b: DataFrame, scale: float = 1.0) -> DataFrame:
    return a.unionByName(b.select("i", "j", (F.col("v") * F.lit(scale)).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def reduce_axis(a: DataFrame, axis: str, how: str = "sum") -> DataFrame:
    """Sums, means, maxima or minima of the given entries by row or by column."""
    key = {"row": "i", "column": "j"}[axis]
    return a.groupBy(key).agg({"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how]("v").alias("v"))


# -- columns that hold matrices --------------------------------------------------------


def row_sums(x: Column) -> Column:
    return F.transform(x, lambda r: F.aggregate(r, F.lit(0.0), lambda a, v: a + v))


def row_means(x: Column) -> Column:
    return F.transform(x, lambda r: F.aggregate(r, F.lit(0.0), lambda a, v: a + v) / F.size(r))


def row_maxs(x: Column) -> Column:
    return F.transform(x, F.array_max)


def row_mins(x: Column) -> Column:
    return F.transform(x, F.array_min)


def transposed(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(x[0]) - 1), lambda j: F.transform(x, lambda r: F.get(r, j)))


def col_sums(x: Column) -> Column:
    return row_sums(transposed(x))


def col_means(x: Column) -> Column:
    return row_means(transposed(x))
