"""Structural equation models by maximum likelihood on a covariance matrix that one fold computes.

``f =~ x1 + x2`` measures a latent variable, ``y ~ f + x`` regresses, ``a ~~ b``
frees a covariance; statements are separated by semicolons or lines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..errors import StatError
from ..functions import distributions as D
from .linear import two_sided
from .optimize import hessian, minimize
from .tests import sample_cov


def decompose_spec(spec: str) -> dict:
    """The measurement, regression and covariance statements of a specification."""
    out = {"measurement": [], "regression": [], "covariance": []}
    for line in spec.replace(";", "\n").splitlines():
        line = line.split("#")[0].strip()
        if not line:
            continue
        for mark, kind in (("=~", "measurement"), ("~~", "covariance"), ("~", "regression")):
            if mark in line:
                left, right = line.split(mark, 1)
                out[kind].append((left.strip(), [t.strip() for t in right.split("+")]))
                break
        else:
            raise StatError("S0201", f"not a statement: {line}")
    return out


def sem(spec: str, df: DataFrame) -> dict:
    """Estimates with standard errors, chi-square, CFI, TLI, RMSEA and SRMR; the first indicator of a latent variable has loading one."""
    parts = decompose_spec(spec)
    latent = [f for f, _ in parts["measurement"]]
    seen = [x for _, xs in parts["measurement"] for x in xs] + [v for y, xs in [*parts["regression"], *parts["covariance"]] for v in (y, *xs)]
    observed = [v for v in dict.fromkeys(seen) if v not in latent]
    names = observed + latent
    at, p, q = {v: i for i, v in enumerate(names)}, len(observed), len(names)
    s = sample_cov(df, observed)
    n = df.dropna(subset=observed).count()
    paths, fixed, covs = [], [], []
    for f, xs in parts["measurement"]:
        fixed.append((at[xs[0]], at[f]))
        paths += [(at[x], at[f], f"{f}=~{x}") for x in xs[1:]]
    for y, xs in parts["regression"]:
        paths += [(at[y], at[x], f"{y}~{x}") for x in xs]
    for a, bs in parts["covariance"]:
        covs += [(at[a], at[b], f"{a}~~{b}") for b in bs if a != b]
    outcomes = {i for i, _, _ in paths} | {i for i, _ in fixed}
    exogenous = [i for i in range(q) if i not in outcomes]
    known = {frozenset(c[:2]) for c in covs}
    covs += [(i, j, f"{names[i]}~~{names[j]}") for k, i in enumerate(exogenous) for j in exogenous[k + 1 :] if frozenset((i, j)) not in known]
    k, c = len(paths), len(covs)
    free = k + c + q

    def implied(t):
        a, w = np.zeros((q, q)), np.diag(np.exp(t[k + c :]))
        for (i, j) in fixed:
            a[i, j] = 1
        for (i, j, _), v in zip(paths, t):
            a[i, j] = v
        for (i, j, _), v in zip(covs, t[k:]):
            w[i, j] = w[j, i] = v
        b = np.linalg.inv(np.eye(q) - a)
        return (b @ w @ b.T)[:p, :p]

    sign, logdet_s = np.linalg.slogdet(s)
    if sign <= 0:
        raise StatError("S0101", "the covariance matrix is singular")

    def discrepancy(t):
        m = implied(t)
        sign, logdet = np.linalg.slogdet(m)
        if sign <= 0 or np.linalg.eigvalsh(m)[0] <= 0:
            return 1e10
        return logdet + np.trace(np.linalg.solve(m, s)) - logdet_s - p

    start = np.concatenate([[0.5 if "=~" in name else 0.1 for _, _, name in paths], np.zeros(c), np.log(np.append(np.diag(s) * 0.5, np.full(q - p, np.diag(s).mean() * 0.5)))])
    for f, xs in parts["measurement"]:  # loadings start at the regression on the first indicator
        for i, (a, b, name) in enumerate(paths):
            if name.startswith(f"{f}=~"):
                start[i] = s[a, at[xs[0]]] / s[at[xs[0]], at[xs[0]]] * 1.5
    best = minimize(discrepancy, start, max_iter=400)
    dof = p * (p + 1) // 2 - free
    chi = (n - 1) * best["value"]
    base, base_df = (n - 1) * (np.log(np.diag(s)).sum() - logdet_s), p * (p - 1) // 2
    gain, base_gain = max(chi - dof, 0), max(base - base_df, chi - dof, 1e-12)
    m = implied(best["par"])
    sd = np.sqrt(np.diag(s))
    low = np.tril_indices(p)
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(hessian(discrepancy, best["par"]) * (n - 1) / 2)), 0))
    table = []
    for i, name in enumerate([x[2] for x in paths] + [x[2] for x in covs] + [f"{v}~~{v}" for v in names]):
        value, err = best["par"][i], se[i]
        if i >= k + c:
            value, err = np.exp(value), np.exp(value) * err
        table.append(dict(term=name, estimate=float(value), std_error=float(err), statistic=float(value / err) if err else float("nan"), p_value=float(two_sided(value / err)) if err else float("nan")))
    return dict(
        table=table, converged=best["converged"], n=n, chi2=float(chi), df=dof, p_value=float(1 - D.chisq(dof).cdf(chi)) if dof else float("nan"), cfi=float(1 - gain / base_gain),
        tli=float((base / base_df - chi / dof) / (base / base_df - 1)) if dof else float("nan"), rmsea=float(np.sqrt(max(chi - dof, 0) / (dof * (n - 1)))) if dof else 0.0,
        srmr=float(np.sqrt((((s - m) / np.outer(sd, sd))[low] ** 2).mean())), implied=m,
    )
