"""Several latent abilities: compensatory and bifactor models by expectation maximisation, and scoring."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StatError
from .fold import fold
from .irt import quadrature

#: Nodes of the product grid; more abilities get fewer nodes each.
MOST_NODES = 3000


def grid(dimensions: int, points: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of a product of normal quadratures."""
    points = points or max(3, int(MOST_NODES ** (1 / dimensions)) | 1)
    points = min(points, 21)
    x, w = quadrature(points, 4.0)
    nodes = np.array(list(itertools.product(x, repeat=dimensions)))
    weights = np.array([np.prod(c) for c in itertools.product(w, repeat=dimensions)])
    return nodes, weights / weights.sum()


def fit_compensatory(df: DataFrame, items: list[str], loads: dict[str, list[int]], dimensions: int, rounds: int = 100, tol: float = 1e-5) -> dict:
    """Slopes and intercepts of items on uncorrelated abilities; ``loads`` names the dimensions each item may load on."""
    table, j = df.select(*items).groupBy(*items).agg(F.count(F.lit(1)).alias("__n")).persist(), len(items)
    x, w = grid(dimensions)
    mask = np.zeros((j, dimensions), dtype=bool)
    for i, name in enumerate(items):
        mask[i, loads[name]] = True
    a, d = np.where(mask, 0.8, 0.0), np.zeros(j)

    def curve():
        return (1 / (1 + np.exp(-np.clip(x @ a.T + d, -40, 40)))).clip(1e-9, 1 - 1e-9)

    last = -np.inf
    for step in range(1, rounds + 1):
        p = curve()
        logs, fails, nodes, prior = np.log(p).T, np.log1p(-p).T, len(x), np.log(w)

        def expected(m):
            y, n = m[:, :-1], m[:, -1]
            there = ~np.isnan(y)
            y0 = np.where(there, y, 0.0)
            ll = y0 @ logs + (there * (1 - y0)) @ fails + prior
            top = ll.max(axis=1, keepdims=True) if len(m) else np.zeros((0, 1))
            total = top + np.log(np.exp(ll - top).sum(axis=1, keepdims=True))
            post = np.exp(ll - total) * n[:, None]
            return np.concatenate([(post.T @ (there * y0)).ravel(), (post.T @ there).ravel(), [(n * total[:, 0]).sum(), n.sum()]])

        out = fold(table, [*items, "__n"], expected)
        r, n = out[: nodes * j].reshape(nodes, j), out[nodes * j : 2 * nodes * j].reshape(nodes, j)
        loglik, persons = float(out[-2]), out[-1]
        if persons < 2:
            raise StatError("S0202", "too few persons")
        for i in range(j):
            use = np.flatnonzero(mask[i])
            z = np.column_stack([x[:, use], np.ones(nodes)])
            for _ in range(8):
                q = (1 / (1 + np.exp(-np.clip(z @ np.append(a[i, use], d[i]), -40, 40))))
                v = n[:, i] * q * (1 - q)
                move = np.clip(np.linalg.solve((z * v[:, None]).T @ z + 1e-6 * np.eye(len(use) + 1), z.T @ (r[:, i] - n[:, i] * q)), -0.5, 0.5)
                a[i, use] = np.clip(a[i, use] + move[:-1], -6, 6)
                d[i] += move[-1]
                if np.abs(move).max() < 1e-6:
                    break
        if abs(loglik - last) < tol * max(1.0, abs(last)) * 1e-1:
            break
        last = loglik
    return dict(items=items, slopes=a, intercepts=d, dimensions=dimensions, log_lik=loglik, aic=-2 * loglik + 2 * (mask.sum() + j), n=int(persons), iterations=step)


def fit_bifactor(df: DataFrame, items: list[str], groups: dict[str, int], **options) -> dict:
    """A general ability and one per group of items; with explained common variance and omega of the general one."""
    fit = fit_compensatory(df, items, {i: [0, 1 + groups[i]] for i in items}, 2 + max(groups.values()), **options)
    standard = fit["slopes"] / 1.702 / np.sqrt(1 + ((fit["slopes"] / 1.702) ** 2).sum(axis=1, keepdims=True))
    squares = standard**2
    general, specific = standard[:, 0].sum() ** 2, sum(standard[:, k].sum() ** 2 for k in range(1, standard.shape[1]))
    return fit | dict(ecv=float(squares[:, 0].sum() / squares.sum()), omega_h=float(general / (general + specific + (1 - squares.sum(axis=1)).sum())))


def score(df: DataFrame, fit: dict) -> DataFrame:
    """Expected a posteriori abilities as an array column."""
    x, w = grid(fit["dimensions"])
    p = (1 / (1 + np.exp(-np.clip(x @ fit["slopes"].T + fit["intercepts"], -40, 40)))).clip(1e-9, 1 - 1e-9)
    logs, fails, prior, items = np.log(p).T, np.log1p(-p).T, np.log(w), fit["items"]

    def run(batches):
        for m in batches:
            y = m[items].to_numpy(float)
            there = ~np.isnan(y)
            y0 = np.where(there, y, 0.0)
            ll = y0 @ logs + (there * (1 - y0)) @ fails + prior
            post = np.exp(ll - ll.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            yield m.assign(theta=list(post @ x))

    return df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", theta array<double>")


def nominal_probabilities(theta: np.ndarray, slopes, intercepts) -> np.ndarray:
    """Category probabilities of the nominal model."""
    z = np.outer(theta, slopes) + np.asarray(intercepts)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bivariate_fit(df: DataFrame, fit: dict) -> dict:
    """Observed against expected pairwise margins of a one-dimensional 0/1 model: standardised residuals and their root mean square."""
    from .irt import probability

    items, j = fit["items"], len(fit["items"])
    x, w = quadrature(61)
    p = probability(x[:, None], fit["a"], fit["b"], fit["c"], fit["d"])
    expected = (p * w[:, None]).T @ p
    out = fold(df.select(*items).dropna(), items, lambda m: np.append((m.T @ m).ravel(), len(m)))
    n = out[-1]
    observed = out[:-1].reshape(j, j) / n
    z = (observed - expected) / np.sqrt(np.maximum(expected * (1 - expected) / n, 1e-12))
    return dict(observed=observed, expected=expected, residuals=z, rms=float(np.sqrt((z[np.triu_indices(j, 1)] ** 2).mean())), n=int(n))
