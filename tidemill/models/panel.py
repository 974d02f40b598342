"""Panel estimators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StatError
from ..functions import distributions as D
from .fold import fold
from .linear import Fit, _solve, feols, ols, two_sided


def pooled(df: DataFrame, outcome: str, regressors: list[str]) -> Fit:
    return ols(f"{outcome} ~ {' + '.join(regressors)}", df)


def within(df: DataFrame, outcome: str, regressors: list[str], unit: str) -> Fit:
    """Unit fixed effects."""
    return feols(f"{outcome} ~ {' + '.join(regressors)} | {unit}", df)


def between(df: DataFrame, outcome: str, regressors: list[str], unit: str) -> Fit:
    means = df.select(unit, outcome, *regressors).dropna().groupBy(unit).agg(*[F.avg(c).alias(c) for c in [outcome, *regressors]])
    return ols(f"{outcome} ~ {' + '.join(regressors)}", means)


def random_effects(df: DataFrame, outcome: str, regressors: list[str], unit: str) -> dict:
    """Feasible generalized least squares with Swamy-Arora variances; unbalanced panels weigh each unit by its own size."""
    cols = [outcome, *regressors]
    rows = df.select(unit, *cols).dropna()
    fe, be = within(rows, outcome, regressors, unit), between(rows, outcome, regressors, unit)
    s2e = fe.stats["rss"] / fe.df_resid
    units, inverse = rows.groupBy(unit).count().agg(F.count(F.lit(1)), F.sum(1 / F.col("count"))).collect()[0]
    harmonic = units / inverse
    s2u = max(be.stats["rss"] / be.df_resid - s2e / harmonic, 0.0)
    means = rows.groupBy(unit).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(f"__m{i}") for i, c in enumerate(cols)])
    theta = 1 - F.sqrt(F.lit(s2e) / (F.lit(s2e) + F.col("__n") * F.lit(s2u)))
    moved = rows.join(means, unit).select(*[(F.col(c) - theta * F.col(f"__m{i}")).alias(f"c{i}") for i, c in enumerate(cols)], (1 - theta).alias("one"))
    names = ["c0", "one", *[f"c{i + 1}" for i in range(len(regressors))]]
    p = len(names)
    out = fold(moved, names, lambda m: np.append((m.T @ m).ravel(), len(m)))
    cross, n = out[:-1].reshape(p, p), int(out[-1])
    bread = _solve(cross[1:, 1:], np.eye(p - 1))
    coef = bread @ cross[1:, 0]
    rss = cross[0, 0] - coef @ cross[1:, 0]
    cov = rss / (n - p + 1) * bread
    return dict(names=["(Intercept)", *regressors], coef=coef, cov=cov, std_error=np.sqrt(np.diag(cov)), sigma_e=np.sqrt(s2e), sigma_u=np.sqrt(s2u), n=n, units=units)


def hausman(fe: Fit, re: dict) -> dict:
    """Fixed against random effects."""
    d = fe.coef - re["coef"][1:]
    v = fe.cov - re["cov"][1:, 1:]
    chi = float(max(d @ np.linalg.pinv(v) @ d, 0))
    return dict(statistic=chi, df=len(d), p_value=float(1 - D.chisq(len(d)).cdf(chi)))


def breusch_pagan(df: DataFrame, outcome: str, regressors: list[str], unit: str) -> dict:
    """Lagrange multiplier test for unit effects from pooled residuals."""
    model = pooled(df, outcome, regressors)
    e = model.predict(df.select(unit, outcome, *regressors).dropna()).select(unit, (F.col(outcome) - F.col("`.fitted`")).alias("e"))
    per = e.groupBy(unit).agg(F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q"), F.count(F.lit(1)).alias("n"))
    s2, q, n, nn = per.agg(F.sum(F.col("s") * F.col("s")), F.sum("q"), F.sum("n"), F.sum(F.col("n") * F.col("n"))).collect()[0]
    lm = n**2 / 2 / (nn - n) * (s2 / q - 1) ** 2
    return dict(statistic=lm, p_value=float(1 - D.chisq(1).cdf(lm)))


def arellano_bond(df: DataFrame, outcome: str, unit: str, time: str, regressors: list[str] = ()) -> dict:
    """First-difference estimator with the second lag as instrument of the lagged difference; tests of serial correlation."""
    w = Window.partitionBy(unit).orderBy(time)
    y = F.col(outcome).cast("double")
    lagged = df.select(unit, time, y.alias("y"), F.lag(y, 1).over(w).alias("y1"), F.lag(y, 2).over(w).alias("y2"), *[(F.col(x) - F.lag(x, 1).over(w)).alias(f"d{i}") for i, x in enumerate(regressors)])
    rows = lagged.select(unit, time, (F.col("y") - F.col("y1")).alias("dy"), (F.col("y1") - F.col("y2")).alias("dl"), F.col("y2").alias("z"), *[f"d{i}" for i in range(len(regressors))]).dropna()
    names = ["dy", "dl", "z", *[f"d{i}" for i in range(len(regressors))]]
    p = len(names)
    out = fold(rows, names, lambda m: np.append((m.T @ m).ravel(), len(m)))
    c, n = out[:-1].reshape(p, p), int(out[-1])
    if n <= p:
        raise StatError("S0201", "too few periods")
    xs, zs = [1, *range(3, p)], [2, *range(3, p)]
    zx = c[np.ix_(zs, xs)]
    coef = np.linalg.solve(zx, c[zs, 0])
    v = np.zeros(p)
    v[0], v[xs] = 1, -coef
    s2 = v @ c @ v / (n - len(coef))
    inv = np.linalg.inv(zx)
    cov = s2 * inv @ c[np.ix_(zs, zs)] @ inv.T
    res = F.col("dy") - sum((F.lit(float(b)) * F.col(names[i]) for b, i in zip(coef, xs)), F.lit(0.0))
    e = rows.select(unit, time, res.alias("e"))
    lags = e.select("e", *[F.lag("e", k).over(w).alias(f"e{k}") for k in (1, 2)])
    r1, r2, n1, n2 = lags.agg(F.corr("e", "e1"), F.corr("e", "e2"), F.count("e1"), F.count("e2")).collect()[0]
    ar = lambda r, m: dict(statistic=None, p_value=None) if r is None else dict(statistic=r * m**0.5, p_value=float(two_sided(r * m**0.5)))
    se = np.sqrt(np.diag(cov))
    return dict(names=["lag", *regressors], coef=coef, std_error=se, p_value=two_sided(coef / se), n=n, ar1=ar(r1, n1), ar2=ar(r2, n2), sargan=0.0)


def blundell_bond(df: DataFrame, outcome: str, unit: str, time: str) -> dict:
    """Difference and level equations together, each with its own instrument, weighted by the instruments' cross products."""
    w = Window.partitionBy(unit).orderBy(time)
    y = F.col(outcome).cast("double")
    lags = df.select(y.alias("y"), *[F.lag(y, k).over(w).alias(f"y{k}") for k in (1, 2)]).dropna()
    diff = lags.select((F.col("y") - F.col("y1")).alias("a"), (F.col("y1") - F.col("y2")).alias("x"), F.lit(0.0).alias("one"), F.col("y2").alias("z1"), F.lit(0.0).alias("z2"), F.lit(0.0).alias("z3"))
    level = lags.select(F.col("y").alias("a"), F.col("y1").alias("x"), F.lit(1.0).alias("one"), F.lit(0.0).alias("z1"), (F.col("y1") - F.col("y2")).alias("z2"), F.lit(1.0).alias("z3"))
    names = ["a", "x", "one", "z1", "z2", "z3"]
    out = fold(diff.unionByName(level), names, lambda m: np.append((m.T @ m).ravel(), len(m)))
    c, n = out[:-1].reshape(6, 6), int(out[-1])
    zz, zx, zy = np.linalg.inv(c[3:, 3:]), c[3:, 1:3], c[3:, 0]
    bread = np.linalg.inv(zx.T @ zz @ zx)
    coef = bread @ zx.T @ zz @ zy
    v = np.array([1, -coef[0], -coef[1], 0, 0, 0])
    s2 = v @ c @ v / (n - 2)
    se = np.sqrt(np.diag(s2 * bread))
    g = zy - zx @ coef
    return dict(names=["lag", "(Intercept)"], coef=coef, std_error=se, n=n, sargan=float(g @ zz @ g / s2), sargan_df=1)


def pesaran_cd(df: DataFrame, value: str, unit: str, time: str) -> dict:
    """Cross-sectional dependence without forming pairs of units, for a balanced panel.

    With each unit's series standardised, the sum of all pairwise correlations
    is half of (sum over times of the squared sum over units) / T less the
    number of units.
    """
    rows = df.filter(F.col(value).isNotNull())
    means = rows.groupBy(unit).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count(F.lit(1)).alias("n")).filter("s > 0")
    z = rows.join(means, unit).withColumn("z", (F.col(value) - F.col("m")) / F.col("s"))
    t, ss = z.groupBy(time).agg(F.sum("z").alias("u")).agg(F.count(F.lit(1)), F.sum(F.col("u") * F.col("u"))).collect()[0]
    n, low, high = means.agg(F.count(F.lit(1)), F.min("n"), F.max("n")).collect()[0]
    if n < 2 or low != high or low != t:
        raise StatError("S0202", "a balanced panel of two units or more is needed")
    total = (ss / t - n) / 2
    cd = float(np.sqrt(2 * t / (n * (n - 1))) * total)
    return dict(statistic=cd, p_value=float(two_sided(cd)), mean_correlation=2 * total / (n * (n - 1)))
