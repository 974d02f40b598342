"""Gaussian mixtures with diagonal covariances by expectation maximisation, one fold an iteration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StatError
from .fold import fold

RIDGE = 1e-4


def gmm(df: DataFrame, columns: list[str], k: int, max_iter: int = 100, tol: float = 1e-4) -> dict:
    """Weights, means, variances, log-likelihood, AIC and BIC of ``k`` components.

    The start is deterministic: quantiles of each column, evenly spaced. Rows
    with a missing cell are left out.
    """
    rows = df.select(*columns).dropna()
    d = len(columns)
    first = fold(rows, columns, lambda x: np.concatenate([x.sum(axis=0), (x**2).sum(axis=0), [len(x)]]))
    n = int(first[-1])
    if n < k:
        raise StatError("S0202", f"{n} rows for {k} components")
    mean, var = first[:d] / n, np.maximum(first[d : 2 * d] / n - (first[:d] / n) ** 2, 1e-12) + RIDGE
    at = [(i + 0.5) / k for i in range(k)]
    q = rows.agg(*[F.percentile_approx(c, at, 10_000) for c in columns]).collect()[0]
    mu, sigma, weight = np.array([list(x) for x in q], dtype=float).T.copy(), np.tile(var, (k, 1)), np.full(k, 1 / k)

    def step(x):
        z = -0.5 * (((x[:, None, :] - mu) ** 2 / sigma).sum(axis=2) + np.log(2 * np.pi * sigma).sum(axis=1)) + np.log(weight)
        top = z.max(axis=1, keepdims=True) if len(x) else np.zeros((0, 1))
        total = top + np.log(np.exp(z - top).sum(axis=1, keepdims=True))
        r = np.exp(z - total)
        return np.concatenate([r.sum(axis=0), (r.T @ x).ravel(), (r.T @ x**2).ravel(), [total.sum()]])

    last, converged = -np.inf, False
    for iteration in range(1, max_iter + 1):
        out = fold(rows, columns, step)
        size, loglik = np.maximum(out[:k], 1e-12), out[-1]
        weight = size / n
        mu = out[k : k + k * d].reshape(k, d) / size[:, None]
        sigma = np.maximum(out[k + k * d : -1].reshape(k, d) / size[:, None] - mu**2, 0) + RIDGE
        if abs(loglik - last) < tol * max(1.0, abs(last)):
            converged = True
            break
        last = loglik
    free = k * 2 * d + k - 1
    return dict(weights=weight, means=mu, variances=sigma, log_lik=float(loglik), aic=float(-2 * loglik + 2 * free), bic=float(-2 * loglik + np.log(n) * free), iterations=iteration, converged=converged)
