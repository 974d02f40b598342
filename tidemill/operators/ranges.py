"""Ordered computations over a whole table without gathering it in one task.

Rows are dealt by range of their order and written, so that a row's range is
settled. One small row per range then tells what comes before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: Range partitions per configured shuffle partition.
SPREAD = 2
#: Rows between which shifted values pass without a common task.
CHUNK = 1 << 18
PART, PLACE = "__part__", "__place__"


def dealt(df: DataFrame, order: Sequence) -> DataFrame:
    """``df`` in range partitions, with the range's number."""
    parts = SPREAD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()))


def before(rows: DataFrame, **aggs: Column) -> DataFrame:
    """Per range the aggregates, each a sum, product, max or min over one, combined over all ranges before it."""
    made = rows.groupBy(PART).agg(*[a.alias(k) for k, (a, _) in aggs.items()])
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    return F.broadcast(made.select(PART, *[f(F.col(k)).over(earlier).alias(k) for k, (_, f) in aggs.items()]))


def placed(df: DataFrame, order: Sequence) -> DataFrame:
    """``df`` with each row's place in the order, from 0."""
    rows = dealt(df, order)
    inside = F.row_number().over(Window.partitionBy(PART).orderBy(*order)) - 1
    counts = before(rows, __n__=(F.count(F.lit(1)), F.sum))
    return rows.join(counts, PART).withColumn(PLACE, F.coalesce("__n__", F.lit(0)) + inside).drop(PART, "__n__")


def shifted(df: DataFrame, order: Sequence, n: int, columns: dict[str, str], ahead: bool) -> DataFrame:
    """Each of ``columns`` (new name: old name) n rows before, or after if ``ahead``; only the n rows at a chunk's border go to two tasks."""
    rows = cut(placed(df, order))
    size = max(CHUNK, n)
    chunk = F.floor(F.col(PLACE) / size)
    inside = F.pmod(F.col(PLACE), F.lit(size))
    near, step = (inside < n, -1) if ahead else (inside >= size - n, 1)
    twice = rows.select("*", F.explode(F.when(near, F.array(F.lit(0), F.lit(step))).otherwise(F.array(F.lit(0)))).alias("__to__")).withColumn("__chunk__", chunk + F.col("__to__"))
    w = Window.partitionBy("__chunk__").orderBy(PLACE)
    move = F.lead if ahead else F.lag
    return twice.withColumns({to: move(c, n).over(w) for to, c in columns.items()}).filter("__to__ = 0").drop("__to__", "__chunk__", PLACE)
