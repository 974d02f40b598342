"""Aggregates that propagate missing values, as specs for ``Frame.summarize``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Agg:
    """An aggregate of one column; ``build`` gets the column's name and the order expression."""

    column: str | None
    build: Callable[[str | None, Column | None], Column]
    ordered: bool = False


def _guarded(make: Callable[[Column], Column], skip_na: bool) -> Callable:
    """Null unless all of the group's values are there, so that a missing value isn't mistaken for none."""

    def build(name, _order):
        c = F.col(name)
        return make(c) if skip_na else F.when(F.count(F.lit(1)) == F.count(c), make(c))

    return build


def mean(column: str, skip_na: bool = False) -> Agg:
    return Agg(column, _guarded(F.avg, skip_na))


def total(column: str, skip_na: bool = False) -> Agg:
    return Agg(column, _guarded(F.sum, skip_na))


def least(column: str, skip_na: bool = False) -> Agg:
    return Agg(column, _guarded(F.min, skip_na))


def greatest(column: str, skip_na: bool = False) -> Agg:
    return Agg(column, _guarded(F.max, skip_na))


def var(column: str, skip_na: bool = False) -> Agg:
    """Sample variance; null for one row."""
    return Agg(column, _guarded(F.var_samp, skip_na))


def std_dev(column: str, skip_na: bool = False) -> Agg:
    return Agg(column, _guarded(F.stddev_samp, skip_na))


def median(column: str, skip_na: bool = False) -> Agg:
    """Exact, the mean of the two middle values for an even count."""
    return Agg(column, _guarded(F.median, skip_na))


def quantile(column: str, p: float) -> Agg:
    """Linear interpolation between order statistics; missing values are skipped."""
    if not 0 <= p <= 1:
        raise ValueError("p must be between 0 and 1")
    return Agg(column, lambda name, _: F.percentile(name, F.lit(p)))


def first(column: str) -> Agg:
    """The value of the first row, which may be missing."""
    return Agg(column, lambda name, order: F.min_by(F.struct(name), order)[name], ordered=True)


def last(column: str) -> Agg:
    return Agg(column, lambda name, order: F.max_by(F.struct(name), order)[name], ordered=True)


def n_distinct(column: str) -> Agg:
    """Distinct values; missing counts as one."""
    return Agg(column, lambda name, _: F.count_distinct(name) + F.max(F.col(name).isNull().cast("long")))


def count() -> Agg:
    return Agg(None, lambda _name, _order: F.count(F.lit(1)))


def dot(left: str, right: str, skip_na: bool = False) -> Agg:
    """Inner product of two columns."""

    def build(_name, _order):
        product = F.col(left) * F.col(right)
        return F.sum(product) if skip_na else F.when(F.count(F.lit(1)) == F.count(product), F.sum(product))

    return Agg(left, build)


def covariance(left: str, right: str) -> Agg:
    """Sample covariance over rows where both are there."""
    return Agg(left, lambda _n, _o: F.covar_samp(left, right))


def correlation(left: str, right: str) -> Agg:
    return Agg(left, lambda _n, _o: F.corr(left, right))
