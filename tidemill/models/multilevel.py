"""Mixed models from per-group sufficient statistics: the rows are read once, iterations need the groups' small matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StatError
from ..functions import distributions as D
from .fold import fold
from .linear import two_sided
from .optimize import minimize


def _group_sums(df: DataFrame, outcome: str, regressors: list[str], group: str) -> tuple[DataFrame, list[str]]:
    """Per group: cross products of (1, x..., y), packed by columns."""
    rows = df.select(group, outcome, *regressors).dropna()
    cells = [F.lit(1.0), *[F.col(x).cast("double") for x in regressors], F.col(outcome).cast("double")]
    names = [f"s{i}_{j}" for i in range(len(cells)) for j in range(i, len(cells))]
    sums = [F.sum(cells[i] * cells[j]) for i in range(len(cells)) for j in range(i, len(cells))]
    return rows.groupBy(group).agg(*[s.alias(n) for s, n in zip(sums, names)]).persist(), names


def _unpack(m: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((len(m), p, p))
    k = 0
    for i in range(p):
        for j in range(i, p):
            out[:, i, j] = out[:, j, i] = m[:, k]
            k += 1
    return out


def _profile(table: DataFrame, names: list[str], p: int, slopes: list[int], theta: np.ndarray):
    """Generalised least squares sums for relative random-effect covariance ``theta theta'``; z are the columns ``slopes`` of (1, x...)."""
    root = np.zeros((len(slopes), len(slopes)))
    root[np.tril_indices(len(slopes))] = theta
    g = root @ root.T

    def run(m):
        s = _unpack(m, p)
        z = slopes
        zz = s[:, z][:, :, z]
        middle = np.eye(len(z)) + zz @ g
        zw = s[:, z, :]
        inner = np.linalg.solve(middle, zw) if len(m) else zw
        adjusted = s - np.einsum("gij,jk,gkl->gil", s[:, :, z], g, inner)
        logdet = np.log(np.linalg.det(middle)).sum() if len(m) else 0.0
        return np.concatenate([adjusted.sum(axis=0).ravel(), [logdet, s[:, 0, 0].sum(), len(m)]])

    out = fold(table, names, run)
    return out[: p * p].reshape(p, p), out[-3], int(out[-2]), int(out[-1]), g


def mixed_model(df: DataFrame, outcome: str, regressors: list[str], group: str, slopes: list[str] = (), reml: bool = True) -> dict:
    """Random intercepts, and random slopes for the named regressors, by maximum (restricted) likelihood over the relative covariance."""
    table, names = _group_sums(df, outcome, regressors, group)
    p = len(regressors) + 2
    z = [0, *[1 + regressors.index(s) for s in slopes]]
    low = np.tril_indices(len(z))
    start = np.array([1.0 if i == j else 0.0 for i, j in zip(*low)])

    def parts(theta):
        c, logdet, n, groups, g = _profile(table, names, p, z, theta)
        xx, xy = c[:-1, :-1], c[:-1, -1]
        beta = np.linalg.solve(xx, xy)
        rss = c[-1, -1] - beta @ xy
        return beta, rss, xx, logdet, n, groups, g

    def loss(theta):
        beta, rss, xx, logdet, n, _, _ = parts(theta)
        k = len(beta) if reml else 0
        return 0.5 * ((n - k) * (np.log(2 * np.pi * max(rss, 1e-300) / (n - k)) + 1) + logdet + (np.linalg.slogdet(xx)[1] if reml else 0.0))

    best = minimize(loss, start, method="nelder-mead", max_iter=120, tol=1e-7)
    beta, rss, xx, _, n, groups, g = parts(best["par"])
    if groups < 2:
        raise StatError("S0202", "two groups or more are needed")
    s2 = rss / (n - (len(beta) if reml else 0))
    cov = s2 * np.linalg.inv(xx)
    se = np.sqrt(np.diag(cov))
    d = s2 * g
    blups = table.select(group, *names)
    return dict(names=["(Intercept)", *regressors], coef=beta, std_error=se, p_value=two_sided(beta / se), sigma2=float(s2), random_cov=d, icc=float(d[0, 0] / (d[0, 0] + s2)), log_lik=-best["value"], n=n, groups=groups, relative=g, slopes=z, table=blups, columns=names, group=group)


def random_effects_of(model: dict) -> DataFrame:
    """The groups' predicted random effects, computed where the groups are."""
    beta, g, z, names, group = model["coef"], model["relative"], model["slopes"], model["columns"], model["group"]
    p = len(beta) + 1

    def run(batches):
        for x in batches:
            s = _unpack(x[names].to_numpy(float), p)
            r = s[:, z, -1] - s[:, z][:, :, : p - 1] @ beta
            zz = s[:, z][:, :, z]
            u = np.einsum("ij,gj->gi", g, np.linalg.solve(np.eye(len(z)) + zz @ g, r[:, :, None])[:, :, 0])
            yield x[[group]].assign(effects=list(u))

    kind = dict(model["table"].dtypes)[model["group"]]
    return model["table"].mapInPandas(run, f"`{model['group']}` {kind}, effects array<double>")


def design_effect(model: dict) -> dict:
    size = model["n"] / model["groups"]
    deff = 1 + (size - 1) * model["icc"]
    return dict(design_effect=deff, effective_n=model["n"] / deff, mean_group_size=size)


def nakagawa_r2(model: dict, df: DataFrame, regressors: list[str]) -> dict:
    """Marginal and conditional shares of explained variance for random intercepts."""
    eta = sum((F.lit(float(b)) * F.col(x) for b, x in zip(model["coef"][1:], regressors)), F.lit(0.0))
    fixed = df.agg(F.var_pop(eta)).collect()[0][0] or 0.0
    u = float(model["random_cov"][0, 0])
    total = fixed + u + model["sigma2"]
    return dict(marginal=fixed / total, conditional=(fixed + u) / total)


def likelihood_ratio(small: dict, large: dict, df: int) -> dict:
    chi = max(2 * (large["log_lik"] - small["log_lik"]), 0.0)
    return dict(statistic=chi, df=df, p_value=float(1 - D.chisq(df).cdf(chi)))
