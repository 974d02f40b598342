"""Sums of per-row contributions as one small vector."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(df: DataFrame, columns: Sequence[str], contribute: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``contribute``, which maps a block of rows (as a float matrix) to a vector of fixed length.

    Each partition adds up its blocks and passes on one vector; these are
    summed by position, so no task gathers rows. Zeros for an empty table.
    """

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = contribute(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(np.asarray(total, dtype=float))], names=["k", "v"])

    cast = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    rows = cast.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows) or len(contribute(np.zeros((0, len(columns))))))
    for r in rows:
        out[r.k] = r.v
    return out


def symmetric(packed: np.ndarray, p: int) -> np.ndarray:
    return packed.reshape(p, p)


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, centred cross products) of complete rows; two passes, so that large offsets cost no digits."""
    first = fold(df, columns, lambda x: np.append(x.sum(axis=0), len(x)))
    n = int(first[-1])
    mean = first[:-1] / max(n, 1)
    p = len(columns)
    cross = fold(df, columns, lambda x: ((x - mean).T @ (x - mean)).ravel())
    return n, mean, cross.reshape(p, p)
