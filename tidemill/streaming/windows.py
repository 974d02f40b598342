"""Windowed aggregates over event streams; the same functions work on bounded tables.

On a stream a watermark bounds the state: rows later than it are dropped, and a
window's state goes once the watermark has passed its end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, lateness: str) -> DataFrame:
    return df.withWatermark(time, lateness) if df.isStreaming else df


def _flat(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


def tumbling(df: DataFrame, time: str, width: str, by: Sequence[str] = (), lateness: str = "10 minutes", **aggs: Column) -> DataFrame:
    """One row per window and group; ``aggs`` are named aggregate expressions, the row count ``n`` by default."""
    made = [a.alias(n) for n, a in aggs.items()] or [F.count(F.lit(1)).alias("n")]
    return _flat(_late(df, time, lateness).groupBy(F.window(time, width).alias("window"), *by).agg(*made))


def sliding(df: DataFrame, time: str, width: str, step: str, by: Sequence[str] = (), lateness: str = "10 minutes", **aggs: Column) -> DataFrame:
    made = [a.alias(n) for n, a in aggs.items()] or [F.count(F.lit(1)).alias("n")]
    return _flat(_late(df, time, lateness).groupBy(F.window(time, width, step).alias("window"), *by).agg(*made))


def sessions(df: DataFrame, time: str, gap: str, by: Sequence[str], lateness: str = "10 minutes", **aggs: Column) -> DataFrame:
    """Windows that a pause of ``gap`` ends."""
    made = [a.alias(n) for n, a in aggs.items()] or [F.count(F.lit(1)).alias("n")]
    return _flat(_late(df, time, lateness).groupBy(F.session_window(time, gap).alias("window"), *by).agg(*made))


def first_seen(df: DataFrame, key: Sequence[str], time: str, lateness: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark's reach."""
    return df.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(key)) if df.isStreaming else df.dropDuplicates(list(key))


def running_totals(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per key, rows and sum so far, emitted with each micro-batch that touches the key; the state is two numbers a key."""
    kind = dict(df.dtypes)[by]
    if not df.isStreaming:
        return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("double")).alias("total"))

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[value].sum())
        state.update((n, total))
        yield pd.DataFrame({by: [key[0]], "n": [n], "total": [total]})

    return df.groupBy(by).applyInPandasWithState(update, f"`{by}` {kind}, n long, total double", "n long, total double", "update", "NoTimeout")
