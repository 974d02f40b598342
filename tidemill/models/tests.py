"""Hypothesis tests from one aggregate each."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StatError
from ..functions import distributions as D


def _tail(dist: D.Distribution, statistic: float, alternative: str) -> float:
    if alternative == "less":
        return float(dist.cdf(statistic))
    if alternative == "greater":
        return float(1 - dist.cdf(statistic))
    return float(2 * min(dist.cdf(statistic), 1 - dist.cdf(statistic)))


p_value = _tail


def conf_int(estimate: float, se: float, dist: D.Distribution | None = None, level: float = 0.95) -> tuple[float, float]:
    q = float((dist or D.normal()).quantile(0.5 + level / 2))
    return estimate - q * se, estimate + q * se


def t_test(df: DataFrame, value: str, group: str, level: float = 0.95) -> dict:
    """Welch's test of two groups' means; the groups are taken in sorted order."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.avg(value), F.var_samp(value), F.count(F.lit(1))).orderBy(group).limit(3).collect()
    if len(rows) != 2 or min(r[3] for r in rows) < 2:
        raise StatError("S0202", "two groups of two rows or more are needed")
    (_, m1, v1, n1), (_, m2, v2, n2) = rows
    a, b = v1 / n1, v2 / n2
    se, dof = math.sqrt(a + b), (a + b) ** 2 / (a**2 / (n1 - 1) + b**2 / (n2 - 1))
    t = (m1 - m2) / se
    dist = D.student_t(dof)
    low, high = conf_int(m1 - m2, se, dist, level)
    return dict(statistic=t, df=dof, p_value=_tail(dist, t, "two_sided"), mean1=m1, mean2=m2, difference=m1 - m2, conf_low=low, conf_high=high)


def t_test_one_sample(df: DataFrame, value: str, mu: float = 0.0, alternative: str = "two_sided", level: float = 0.95) -> dict:
    m, v, n = df.filter(F.col(value).isNotNull()).agg(F.avg(value), F.var_samp(value), F.count(value)).collect()[0]
    if n < 2:
        raise StatError("S0202", "two rows or more are needed")
    se = math.sqrt(v / n)
    dist = D.student_t(n - 1)
    low, high = conf_int(m, se, dist, level)
    return dict(statistic=(m - mu) / se, df=n - 1, p_value=_tail(dist, (m - mu) / se, alternative), mean=m, conf_low=low, conf_high=high)


def z_test_one_sample(df: DataFrame, value: str, sigma: float, mu: float = 0.0, alternative: str = "two_sided") -> dict:
    m, n = df.filter(F.col(value).isNotNull()).agg(F.avg(value), F.count(value)).collect()[0]
    z = (m - mu) / (sigma / math.sqrt(n))
    low, high = conf_int(m, sigma / math.sqrt(n))
    return dict(statistic=z, p_value=_tail(D.normal(), z, alternative), mean=m, conf_low=low, conf_high=high)


def chisq_test(df: DataFrame, column: str) -> dict:
    """Goodness of fit of a column's frequencies to equal ones; the counts stay distributed, only their moments come back."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    k, total, squares = counts.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))).collect()[0]
    if k < 2:
        raise StatError("S0202", "two values or more are needed")
    statistic = squares * k / total - total
    return dict(statistic=statistic, df=k - 1, p_value=float(1 - D.chisq(k - 1).cdf(statistic)), n=total)


def cor_test(df: DataFrame, x: str, y: str, level: float = 0.95) -> dict:
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r, n = rows.agg(F.corr(x, y), F.count(F.lit(1))).collect()[0]
    if n < 4 or r is None:
        raise StatError("S0202", "too few rows, or a constant column")
    t = r * math.sqrt((n - 2) / max(1 - r * r, 1e-300))
    z, half = math.atanh(min(max(r, -1 + 1e-16), 1 - 1e-16)), float(D.normal().quantile(0.5 + level / 2)) / math.sqrt(n - 3)
    return dict(estimate=r, statistic=t, df=n - 2, p_value=_tail(D.student_t(n - 2), t, "two_sided"), conf_low=math.tanh(z - half), conf_high=math.tanh(z + half))


def sample_cov(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sample covariance matrix of complete rows."""
    from .fold import moments

    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    n, _, cross = moments(df.filter(ok), columns)
    if n < 2:
        raise StatError("S0202", "two complete rows or more are needed")
    return cross / (n - 1)


def bootstrap_mean(df: DataFrame, value: str, replicas: int, seed: int = 0) -> list[float]:
    """Means of Poisson-weighted resamples; a row's weights depend on the seed, the replica and the row only, not on the partitions."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.xxhash64(*df.columns).alias("h"))
    out = []
    table = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]).tolist()
    for first in range(0, replicas, 100):
        aggs = []
        for r in range(first, min(first + 100, replicas)):
            u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(r), "h"), 11).cast("double") + 0.5) / F.lit(float(2**53))
            w = sum((F.when(u > t, 1).otherwise(0) for t in table), F.lit(0))
            aggs.append(F.sum(w * F.col("v")) / F.sum(w))
        out += list(rows.agg(*[a.alias(f"m{i}") for i, a in enumerate(aggs)]).collect()[0])
    return out
