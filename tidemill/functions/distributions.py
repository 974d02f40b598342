"""Probability distributions: densities, distribution functions and quantiles on numpy arrays and on columns, and seeded draws.

``pdf`` and closed-form functions could be column arithmetic; those that need
special functions run as Arrow-batched pandas UDFs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StatError
from . import special as sp
from .special import _lgamma

_INF = float("inf")


@dataclass(frozen=True)
class Distribution:
    """A named distribution with its parameters fixed."""

    name: str
    args: tuple

    def density(self, x):
        return _DENSITY[self.name](np.asarray(x, float), *self.args)

    pdf = pmf = density

    def cdf(self, x):
        return _CDF[self.name](np.asarray(x, float), *self.args)

    def quantile(self, p):
        p = np.asarray(p, float)
        low, high = _SUPPORT[self.name](*self.args)
        if self.name in ("binomial", "poisson"):
            # the least whole number whose cumulated probability reaches p
            guess = np.ceil(sp.invert(lambda x: self.cdf(np.floor(x)), p, low - 1.0, high, 120) - 1e-9)
            guess = np.where(self.cdf(guess - 1) >= p * (1 - 1e-14), guess - 1, guess)
            return np.maximum(guess, low)
        return sp.invert(self.cdf, p, low, high)

    def column(self, what: str, x) -> Column:
        """``density``, ``cdf`` or ``quantile`` of a column; missing stays missing."""
        def run(s: pd.Series) -> pd.Series:
            with np.errstate(all="ignore"):
                return pd.Series(getattr(self, what)(s.to_numpy(dtype=float, na_value=np.nan)))

        value = F.pandas_udf(run, "double")(F.col(x) if isinstance(x, str) else x)
        return F.when(~F.isnan(value), value)

    def sample(self, spark: SparkSession, n: int, seed: int) -> DataFrame:
        """n draws (id, value): each by inversion of a uniform that depends on seed and id alone, so any partitioning gives the same."""
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11).cast("double")
        u = (bits + 0.5) / F.lit(float(2**53))
        return spark.range(n).select("id", self.column("quantile", u).alias("value"))


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise StatError("S0202", what)


def normal(mean: float = 0.0, sd: float = 1.0) -> Distribution:
    _check(sd > 0, "sd must be positive")
    return Distribution("normal", (mean, sd))


def gamma(shape: float, rate: float = 1.0) -> Distribution:
    _check(shape > 0 and rate > 0, "shape and rate must be positive")
    return Distribution("gamma", (shape, rate))


def student_t(df: float, loc: float = 0.0, scale: float = 1.0) -> Distribution:
    _check(df > 0 and scale > 0, "df and scale must be positive")
    return Distribution("student_t", (df, loc, scale))


def fisher_f(df1: float, df2: float) -> Distribution:
    _check(df1 > 0 and df2 > 0, "degrees of freedom must be positive")
    return Distribution("fisher_f", (df1, df2))


def chisq(df: float) -> Distribution:
    _check(df > 0, "df must be positive")
    return Distribution("gamma", (df / 2, 0.5))


def beta(a: float, b: float) -> Distribution:
    _check(a > 0 and b > 0, "a and b must be positive")
    return Distribution("beta", (a, b))


def uniform(low: float = 0.0, high: float = 1.0) -> Distribution:
    _check(low < high, "low must be below high")
    return Distribution("uniform", (low, high))


def exponential(rate: float = 1.0) -> Distribution:
    _check(rate > 0, "rate must be positive")
    return Distribution("gamma", (1.0, rate))


def binomial(n: int, p: float) -> Distribution:
    _check(n >= 0 and 0 <= p <= 1, "n must not be negative, p a probability")
    return Distribution("binomial", (n, p))


def poisson(rate: float) -> Distribution:
    _check(rate > 0, "rate must be positive")
    return Distribution("poisson", (rate,))


def _inside(x, low, high, made):
    with np.errstate(all="ignore"):
        return np.where(np.isnan(x), np.nan, np.where((x >= low) & (x <= high), made(np.clip(x, low, high)), 0.0))


def _whole(x, top, made):
    ok = (x == np.floor(x)) & (x >= 0) & (x <= top)
    return np.where(np.isnan(x), np.nan, np.where(ok, made(np.where(ok, x, 0)), 0.0))


def _log_choose(n, k):
    return _lgamma(n + 1.0) - _lgamma(k + 1) - _lgamma(n - k + 1)


def _binomial_mass(x, n, p):
    if p in (0, 1):
        return _whole(x, n, lambda k: (k == n * p).astype(float))
    return _whole(x, n, lambda k: np.exp(_log_choose(n, k) + k * np.log(p) + (n - k) * np.log1p(-p)))


def _t_cdf(x, df, loc, scale):
    z = (x - loc) / scale
    tail = 0.5 * sp.beta_inc(df / 2, 0.5, df / (df + z * z))
    return np.where(z > 0, 1 - tail, tail)


def _step(x, made, top=_INF):
    k = np.floor(x)
    return np.where(np.isnan(x), np.nan, np.where(k < 0, 0.0, np.where(k >= top, 1.0, made(np.clip(k, 0, None)))))


def _f_density(x, a, b):
    return np.exp(_lgamma((a + b) / 2) - _lgamma(a / 2) - _lgamma(b / 2) + a / 2 * np.log(a / b) + (a / 2 - 1) * np.log(x) - (a + b) / 2 * np.log1p(a * x / b))


_DENSITY = {
    "normal": lambda x, m, s: np.exp(-0.5 * ((x - m) / s) ** 2) / (s * np.sqrt(2 * np.pi)),
    "gamma": lambda x, k, r: _inside(x, 0, _INF, lambda v: np.where(v == 0, {True: r}.get(k == 1, 0.0 if k > 1 else _INF), np.exp(k * np.log(r) + (k - 1) * np.log(v) - r * v - _lgamma(k)))),
    "student_t": lambda x, d, m, s: np.exp(_lgamma((d + 1) / 2) - _lgamma(d / 2) - 0.5 * np.log(d * np.pi) - (d + 1) / 2 * np.log1p(((x - m) / s) ** 2 / d)) / s,
    "fisher_f": lambda x, a, b: _inside(x, 0, _INF, lambda v: _f_density(v, a, b)),
    "beta": lambda x, a, b: _inside(x, 0, 1, lambda v: np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + (a - 1) * np.log(v) + (b - 1) * np.log1p(-v))),
    "uniform": lambda x, a, b: _inside(x, a, b, lambda v: np.full(np.shape(v), 1 / (b - a))),
    "binomial": _binomial_mass,
    "poisson": lambda x, r: _whole(x, _INF, lambda k: np.exp(k * np.log(r) - r - _lgamma(k + 1))),
}
_CDF = {
    "normal": lambda x, m, s: sp.normal_cdf((x - m) / s),
    "gamma": lambda x, k, r: np.where(np.isnan(x), np.nan, sp.gamma_inc(k, np.maximum(r * x, 0))),
    "student_t": _t_cdf,
    "fisher_f": lambda x, a, b: sp.beta_inc(a / 2, b / 2, np.where(x > 0, a * np.maximum(x, 0) / (a * np.maximum(x, 0) + b), 0.0)),
    "beta": lambda x, a, b: sp.beta_inc(a, b, np.clip(x, 0, 1)),
    "uniform": lambda x, a, b: np.clip((x - a) / (b - a), 0, 1),
    "binomial": lambda x, n, p: _step(x, lambda k: sp.beta_inc(n - np.minimum(k, n - 1), np.minimum(k, n - 1) + 1, 1 - p), n),
    "poisson": lambda x, r: _step(x, lambda k: 1 - sp.gamma_inc(k + 1, r)),
}
_SUPPORT = {
    "normal": lambda *_: (-_INF, _INF),
    "gamma": lambda *_: (0.0, _INF),
    "student_t": lambda *_: (-_INF, _INF),
    "fisher_f": lambda *_: (0.0, _INF),
    "beta": lambda *_: (0.0, 1.0),
    "uniform": lambda a, b: (a, b),
    "binomial": lambda n, p: (0.0, float(n)),
    "poisson": lambda *_: (0.0, _INF),
}
