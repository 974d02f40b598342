"""Functions of array columns: vector algebra, reductions and element-wise maps, all inside the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _whole(x: Column, made: Column) -> Column:
    """Missing if any element is."""
    return F.when(~F.exists(x, lambda v: v.isNull()), made)


def vec_sum(x) -> Column:
    x = _col(x)
    return _whole(x, F.aggregate(x, F.lit(0.0), lambda a, v: a + v))


def vec_mean(x) -> Column:
    x = _col(x)
    return F.when(F.size(x) > 0, vec_sum(x) / F.size(x))


def vec_min(x) -> Column:
    x = _col(x)
    return _whole(x, F.array_min(x))


def vec_max(x) -> Column:
    x = _col(x)
    return _whole(x, F.array_max(x))


def vec_dot(x, y) -> Column:
    """Inner product of arrays of equal length; missing if any element is, or if the lengths differ."""
    x, y = _col(x), _col(y)
    products = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return F.when(F.size(x) == F.size(y), vec_sum(products))


def vec_add(x, y) -> Column:
    return F.zip_with(_col(x), _col(y), lambda a, b: a + b)


def vec_subtract(x, y) -> Column:
    return F.zip_with(_col(x), _col(y), lambda a, b: a - b)


def vec_multiply(x, y) -> Column:
    return F.zip_with(_col(x), _col(y), lambda a, b: a * b)


def vec_scale(x, k) -> Column:
    return F.transform(_col(x), lambda v: v * F.lit(k))


def vec_norm(x) -> Column:
    return F.sqrt(vec_dot(x, x))


def cosine(x, y) -> Column:
    return vec_dot(x, y) / (vec_norm(x) * vec_norm(y))


def log_sum_exp(x) -> Column:
    """log of the sum of exponentials, taken relative to the largest."""
    x = F.transform(_col(x), lambda v: v.cast("double"))
    top = F.array_max(x)
    return top + F.ln(F.aggregate(F.transform(x, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v))


def softmax(x) -> Column:
    x = F.transform(_col(x), lambda v: v.cast("double"))
    top = F.array_max(x)
    raised = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(raised, lambda v: v / F.aggregate(raised, F.lit(0.0), lambda a, u: a + u))


def vec_map(x, f: Callable[[Column], Column]) -> Column:
    return F.transform(_col(x), f)


def vec_filter(x, f: Callable[[Column], Column]) -> Column:
    return F.filter(_col(x), f)


def vec_reduce(x, start, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(_col(x), F.lit(start), f)


def filter_na(x) -> Column:
    return F.filter(_col(x), lambda v: v.isNotNull())


def vec_sort(x, descending: bool = False) -> Column:
    return F.sort_array(_col(x), not descending)


def append(x, *values) -> Column:
    return F.concat(_col(x), F.array(*[F.lit(v) for v in values]))
