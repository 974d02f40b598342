"""Least squares, generalized linear models, fixed effects, instruments and penalties."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StatError
from ..functions import distributions as D
from ..sources.scratch import cut, remove
from .fold import fold, moments
from .formula import Design, Formula, complete, design

TOLERANCE, ROUNDS = 1e-8, 25


def two_sided(statistic, df: float | None = None):
    """Two-sided p values by Student's t with df degrees of freedom, or by the normal distribution."""
    dist = D.normal() if df is None else D.student_t(df)
    return 2 * dist.cdf(-np.abs(statistic))


def _solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    if np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-11) < len(gram):
        raise StatError("S0101", "the design is singular")
    return np.linalg.solve(gram / np.outer(scale, scale), (right.T / scale).T if right.ndim == 1 else right / scale[:, None]) / (scale if right.ndim == 1 else scale[:, None])


@dataclass
class Fit:
    """Estimates of a model over named terms, with what its summaries need."""

    kind: str
    made: Design
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    df_resid: float
    stats: dict = field(default_factory=dict)
    rows: DataFrame | None = None
    columns: list[str] = field(default_factory=list)
    bread: np.ndarray | None = None
    link: str = "identity"

    def std_error(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    def tidy(self) -> list[dict]:
        se = self.std_error()
        t = self.coef / se
        p = two_sided(t, self.df_resid if self.link == "identity" else None)
        return [dict(term=n, estimate=float(b), std_error=float(s), statistic=float(z), p_value=float(q)) for n, b, s, z, q in zip(self.names, self.coef, se, t, p)]

    def glance(self) -> dict:
        return {"n": self.n, "df_resid": self.df_resid, **self.stats}

    def _eta(self):
        e = F.lit(float(self.coef[0]) if self.made.intercept else 0.0)
        for b, c in zip(self.coef[1:] if self.made.intercept else self.coef, self.made.columns):
            e = e + F.lit(float(b)) * c
        return e

    def predict(self, df: DataFrame, name: str = ".fitted") -> DataFrame:
        """``df`` with the fitted mean of each row; missing where a term is, or has a level not seen before."""
        eta = self._eta()
        for x, levels in self.made.levels.items():
            eta = F.when(F.col(x).isin(levels), eta)
        mean = {"identity": eta, "logit": 1 / (1 + F.exp(-eta)), "log": F.exp(eta)}[self.link]
        return df.withColumn(name, mean)

    def augment(self, df: DataFrame) -> DataFrame:
        """``df`` with .fitted, .residual, whether the row was used, and why not."""
        out = self.predict(df)
        used = F.col("`.fitted`").isNotNull() & F.col(self.made.formula.response).isNotNull()
        why = F.lit(None).cast("string")
        for x in [self.made.formula.response, *self.made.sources]:
            why = F.coalesce(why, F.when(F.col(x).isNull(), F.lit(f"missing {x}")))
        return out.withColumn(".residual", F.col(self.made.formula.response).cast("double") - F.col("`.fitted`")).withColumn(".used_in_fit", used).withColumn(".na_reason", why)

    def vcov(self, kind: str = "classical", cluster: str | None = None) -> np.ndarray:
        """Covariance of the estimates: classical, HC0 to HC3, or by cluster; the last two read the rows again."""
        if kind.lower() == "classical":
            return self.cov
        if self.bread is None or self.rows is None:
            raise StatError("S0203", "this fit has no rows to read again")
        b, coef, one = self.bread, self.coef, self.made.intercept
        p = len(coef)

        def parts(m):
            x = np.column_stack([np.ones(len(m)), m[:, 1:]]) if one else m[:, 1:]
            return x, m[:, 0] - x @ coef

        if kind.upper() in ("HC0", "HC1", "HC2", "HC3"):
            power = {"HC2": 1, "HC3": 2}.get(kind.upper(), 0)

            def meat(m):
                x, e = parts(m)
                h = np.einsum("ij,jk,ik->i", x, b, x) if power else 0.0
                return (x.T @ (x * (e**2 / (1 - h) ** power)[:, None])).ravel() if len(m) else np.zeros(p * p)

            m = fold(self.rows, self.columns, meat).reshape(p, p)
            return b @ m @ b * (self.n / (self.n - p) if kind.upper() == "HC1" else 1.0)
        if kind.lower() == "cluster" and cluster:
            # scores are summed by cluster first, then folded: no cluster meets in one task as rows
            eps = F.col(self.columns[0]) - sum((F.lit(float(c)) * x for c, x in zip(coef, [F.lit(1.0)] * one + [F.col(x) for x in self.columns[1:]])), F.lit(0.0))
            xs = [F.lit(1.0)] * one + [F.col(x) for x in self.columns[1:]]
            sums = self.rows.groupBy(cluster).agg(*[F.sum(x * eps).alias(f"s{i}") for i, x in enumerate(xs)])
            names = [f"s{i}" for i in range(p)]
            out = fold(sums, names, lambda m: np.append((m.T @ m).ravel(), len(m)))
            g = out[-1]
            return b @ out[:-1].reshape(p, p) @ b * (g / (g - 1)) * ((self.n - 1) / (self.n - p))
        raise StatError("S0203", f"no covariance {kind}")


def ols(formula: str, df: DataFrame, contrasts: dict[str, str] | None = None, cluster: str | None = None) -> Fit:
    """Ordinary least squares by centred cross products."""
    f = Formula.parse(formula)
    made = design(df, f, True, contrasts)
    rows, names = complete(df, made, (cluster,) if cluster else ())
    n, mean, cross = moments(rows, names)
    p = len(names)  # with the intercept
    if n <= p:
        raise StatError("S0201", f"{n} rows for {p} terms")
    sxx, sxy = cross[1:, 1:], cross[1:, 0]
    slope = _solve(sxx, sxy) if p > 1 else np.zeros(0)
    rss = max(cross[0, 0] - slope @ sxy, 0.0)
    if rss < 1e-10 * cross[0, 0]:  # cancellation: read the residuals themselves
        b0 = mean[0] - slope @ mean[1:]
        rss = float(fold(rows, names, lambda m: np.array([((m[:, 0] - b0 - m[:, 1:] @ slope) ** 2).sum()]))[0])
    inverse = _solve(sxx, np.eye(p - 1)) if p > 1 else np.zeros((0, 0))
    bread = np.zeros((p, p))
    bread[1:, 1:] = inverse
    bread[0, 1:] = bread[1:, 0] = -mean[1:] @ inverse
    bread[0, 0] = 1 / n + mean[1:] @ inverse @ mean[1:]
    coef = np.append(mean[0] - slope @ mean[1:], slope)
    df_resid, tss = n - p, cross[0, 0]
    s2 = rss / df_resid
    r2 = 1 - rss / tss if tss > 0 else float("nan")
    fstat = (tss - rss) / max(p - 1, 1) / s2 if s2 > 0 and p > 1 else float("nan")
    loglik = -0.5 * n * (np.log(2 * np.pi * s2) + df_resid / n) if s2 > 0 else float("inf")
    stats = dict(
        r_squared=r2, adj_r_squared=1 - (1 - r2) * (n - 1) / df_resid, sigma=float(np.sqrt(s2)), f_statistic=float(fstat), f_p_value=float(1 - D.fisher_f(p - 1, df_resid).cdf(fstat)) if p > 1 and fstat == fstat else float("nan"),
        log_lik=float(loglik), aic=float(-2 * loglik + 2 * (p + 1)), bic=float(-2 * loglik + np.log(n) * (p + 1)), rss=float(rss), tss=float(tss),
        vif=dict(zip(made.names, (np.diag(sxx) * np.diag(inverse)).tolist())),
    )
    return Fit("ols", made, ["(Intercept)", *made.names], coef, s2 * bread, n, df_resid, stats, rows, names, bread)


fit = ols


def _irls(kind: str, formula: str, df: DataFrame, link: str, check, weigh, deviance) -> Fit:
    f = Formula.parse(formula)
    made = design(df, f)
    rows, names = complete(df, made)
    low, high, n, total = fold_range(rows)
    if n <= len(names):
        raise StatError("S0201", f"{n} rows for {len(names)} terms")
    check(rows, low, high)
    p, mean = len(names), total / n
    coef = np.zeros(p)
    coef[0] = np.log(max(mean, 1e-10) / max(1 - mean, 1e-10)) if link == "logit" else np.log(max(mean, 1e-10))

    def pass_over(beta):
        def run(m):
            x = np.column_stack([np.ones(len(m)), m[:, 1:]])
            mu, w = weigh(np.clip(x @ beta, -500, 500))
            w = np.maximum(w, 1e-10)
            return np.concatenate([(x.T @ (x * w[:, None])).ravel(), x.T @ (m[:, 0] - mu), [deviance(m[:, 0], mu).sum()]])

        return fold(rows, names, run)

    for step in range(ROUNDS):
        out = pass_over(coef)
        gram, score = out[: p * p].reshape(p, p), out[p * p : -1]
        move = _solve(gram, score)
        coef = coef + move
        if np.abs(move).max() < TOLERANCE:
            break
    else:
        raise StatError("S0205", f"no convergence in {ROUNDS} steps")
    out = pass_over(coef)
    gram, dev = out[: p * p].reshape(p, p), float(out[-1])
    null = float(fold(rows, names, lambda m: np.array([deviance(m[:, 0], np.full(len(m), mean)).sum()]))[0])
    inverse = _solve(gram, np.eye(p))
    stats = dict(deviance=dev, null_deviance=null, mcfadden_r2=1 - dev / null if null else float("nan"), iterations=step + 1)
    return Fit(kind, made, ["(Intercept)", *made.names], coef, inverse, n, n - p, stats, rows, names, None, link)


def fold_range(rows: DataFrame):
    r = rows.agg(F.min("__y"), F.max("__y"), F.count(F.lit(1)), F.sum("__y")).collect()[0]
    return r[0], r[1], r[2], r[3] or 0.0


def _entropy(y, mu):
    mu = np.clip(mu, 1e-15, 1 - 1e-15)
    return -2 * (y * np.log(mu) + (1 - y) * np.log1p(-mu))


def logistic(formula: str, df: DataFrame) -> Fit:
    """Logistic regression of a 0/1 response by iteratively reweighted least squares."""

    def check(rows, low, high):
        if rows.filter("__y not in (0, 1)").limit(1).count():
            raise StatError("S0204", "the response must be 0 or 1")

    def weigh(eta):
        mu = np.where(eta >= 0, 1 / (1 + np.exp(-np.abs(eta))), np.exp(-np.abs(eta)) / (1 + np.exp(-np.abs(eta))))
        return mu, mu * (1 - mu)

    return _irls("logistic", formula, df, "logit", check, weigh, _entropy)


def poisson(formula: str, df: DataFrame) -> Fit:
    """Poisson regression with log link."""

    def check(rows, low, high):
        if low < 0:
            raise StatError("S0204", "the response must not be negative")

    def weigh(eta):
        mu = np.exp(eta)
        return mu, mu

    def deviance(y, mu):
        return 2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu))

    return _irls("poisson", formula, df, "log", check, weigh, deviance)


def feols(formula: str, df: DataFrame, vcov: str = "classical", cluster: str | None = None, rounds: int = 1000, tolerance: float = 1e-9) -> Fit:
    """Least squares with absorbed fixed effects, ``y ~ x | a + b``.

    One factor is absorbed exactly by group means, several by alternating
    projections. Means are aggregated and joined back, so a factor level with
    very many rows is pre-summed and its join can be split.
    """
    f = Formula.parse(formula)
    effects = f.parts[0] if f.parts else ()
    if not effects:
        return ols(formula, df, cluster=cluster)
    made = design(df, f, intercept=False)
    rows, names = complete(df, made, (*effects, *((cluster,) if cluster else ())))
    for e in effects:
        rows = rows.filter(F.col(e).isNotNull())

    def without(frame, e):
        means = frame.groupBy(e).agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(names)])
        joined = frame.join(means, e)
        return joined.select(*[c for c in frame.columns if c not in names], *[(F.col(c) - F.col(f"__m{i}")).alias(c) for i, c in enumerate(names)])

    levels = [rows.select(e).distinct().count() for e in effects]
    if len(effects) == 1:
        rows = without(rows, effects[0])
    else:
        last, rows_before = None, rows
        for _ in range(rounds):
            for e in effects:
                rows = without(rows, e)
            older, rows = rows_before, cut(rows)
            remove(older)
            rows_before = rows
            now = fold(rows, names, lambda m: (m**2).sum(axis=0))
            if last is not None and np.all(np.abs(now - last) <= tolerance * np.maximum(now, 1e-30)):
                break
            last = now
        else:
            raise StatError("S0203", f"the fixed effects did not settle in {rounds} rounds")
    p = len(names) - 1
    cross = fold(rows, names, lambda m: np.append((m.T @ m).ravel(), len(m)))
    n, cross = int(cross[-1]), cross[:-1].reshape(p + 1, p + 1)
    absorbed = levels[0] + sum(g - 1 for g in levels[1:])
    df_resid = n - p - absorbed
    if df_resid <= 0:
        raise StatError("S0201", "no degrees of freedom left")
    bread = _solve(cross[1:, 1:], np.eye(p))
    coef = bread @ cross[1:, 0]
    rss = cross[0, 0] - coef @ cross[1:, 0]
    out = Fit("feols", made, list(made.names), coef, rss / df_resid * bread, n, df_resid, dict(r_squared_within=1 - rss / cross[0, 0], rss=float(rss), absorbed=absorbed), rows, names, bread)
    if vcov.lower() == "hc1":
        out.cov = out.vcov("HC0") * n / df_resid
    elif cluster:
        out.cov = out.vcov("cluster", cluster)
    return out


def iv(formula: str, df: DataFrame, vcov: str = "classical") -> Fit:
    """Two-stage least squares ``y ~ x | z``: regressors among the instruments are exogenous.

    One pass over centred cross products of response, regressors and
    instruments; reports first-stage F, Wu-Hausman and Sargan statistics.
    """
    f = Formula.parse(formula)
    if not f.parts:
        raise StatError("S0101", "no instruments")
    x_terms, z_terms = f.terms, tuple(dict.fromkeys((*f.parts[0], *[t for t in f.terms if t in f.parts[0]])))
    made = design(df, Formula(f.response, x_terms))
    tools = design(df, Formula(f.response, z_terms))
    both = Design(f, True, made.names + tools.names, made.columns + tools.columns, {**made.levels, **tools.levels})
    rows, names = complete(df, both)
    n, mean, c = moments(rows, names)
    k, q = len(made.names), len(tools.names)
    if q < k:
        raise StatError("S0101", "fewer instruments than regressors")
    y, x, z = slice(0, 1), slice(1, 1 + k), slice(1 + k, 1 + k + q)
    zz = _solve(c[z, z], np.eye(q))
    proj = c[x, z] @ zz
    xpx, xpy = proj @ c[z, x], proj @ c[z, y][:, 0]
    bread = _solve(xpx, np.eye(k))
    slope = bread @ xpy
    rss = c[0, 0] - 2 * slope @ c[x, y][:, 0] + slope @ c[x, x] @ slope
    df_resid = n - k - 1
    s2 = rss / df_resid
    coef = np.append(mean[0] - slope @ mean[x], slope)
    full = np.zeros((k + 1, k + 1))
    full[1:, 1:] = bread
    full[0, 1:] = full[1:, 0] = -mean[x] @ bread
    full[0, 0] = 1 / n + mean[x] @ bread @ mean[x]
    endogenous = [i for i, t in enumerate(made.names) if t not in tools.names]
    stats = dict(rss=float(rss), sigma=float(np.sqrt(s2)))
    exo = [i for i, t in enumerate(tools.names) if t in made.names]
    own = [i for i in range(q) if i not in exo]
    if endogenous:
        i = endogenous[0]
        full_rss = c[1 + i, 1 + i] - proj[i] @ c[z, x][:, i]
        ze = [1 + k + j for j in exo]
        part = c[1 + i, ze] @ np.linalg.solve(c[np.ix_(ze, ze)], c[ze, 1 + i]) if ze else 0.0
        stats["first_stage_f"] = float((c[1 + i, 1 + i] - part - full_rss) / max(len(own), 1) / (full_rss / (n - q - 1)))
        # Wu-Hausman: the first-stage residuals added to the structural equation
        m = len(endogenous)
        a = np.zeros((k + m, c.shape[0]))
        a[:k, x] = np.eye(k)
        for r, i in enumerate(endogenous):
            a[k + r, 1 + i] = 1
            a[k + r, z] = -proj[i]
        g, h = a @ c @ a.T, a @ c[:, 0]
        restricted = c[0, 0] - h[:k] @ np.linalg.solve(g[:k, :k], h[:k])
        unrestricted = c[0, 0] - h @ np.linalg.solve(g, h)
        stats["wu_hausman"] = float((restricted - unrestricted) / m / (unrestricted / (n - k - m - 1)))
    if q > k:
        ze = c[z, y][:, 0] - c[z, x] @ slope
        stats["sargan"] = float(n * (ze @ zz @ ze) / rss)
        stats["sargan_p_value"] = float(1 - D.chisq(q - k).cdf(stats["sargan"]))
    out = Fit("iv", made, ["(Intercept)", *made.names], coef, s2 * full, n, df_resid, stats)
    if vcov.upper() == "HC1":
        mz = mean[z]

        def meat(m):
            fitted = (m[:, 1 + k :] - mz) @ proj.T
            e = m[:, 0] - coef[0] - m[:, 1 : 1 + k] @ slope
            w = np.column_stack([np.ones(len(m)), fitted + mean[x]])
            return (w.T @ (w * (e**2)[:, None])).ravel()

        out.cov = full @ fold(rows, names, meat).reshape(k + 1, k + 1) @ full * n / df_resid
    return out


@dataclass
class Path:
    """Coefficients along a path of penalties."""

    names: list[str]
    lambdas: np.ndarray
    coefs: np.ndarray
    intercepts: np.ndarray
    cv_mean: np.ndarray | None = None
    cv_se: np.ndarray | None = None
    lambda_min: float | None = None
    lambda_1se: float | None = None

    def coef(self, penalty: float | None = None) -> dict[str, float]:
        k = int(np.abs(self.lambdas - (self.lambda_min if penalty is None else penalty)).argmin()) if penalty is not None or self.lambda_min is not None else -1
        return {"(Intercept)": float(self.intercepts[k]), **dict(zip(self.names, self.coefs[k].tolist()))}


def _descent(gram: np.ndarray, right: np.ndarray, lam: float, alpha: float, start: np.ndarray) -> np.ndarray:
    """Coordinate descent on standardised cross products."""
    b = start.copy()
    for _ in range(10_000):
        moved = 0.0
        for j in range(len(b)):
            r = right[j] - gram[j] @ b + gram[j, j] * b[j]
            new = np.sign(r) * max(abs(r) - lam * alpha, 0.0) / (gram[j, j] + lam * (1 - alpha))
            moved = max(moved, abs(new - b[j]))
            b[j] = new
        if moved < 1e-7:
            break
    return b


def _path(n, mean, cross, alpha, lambdas):
    sd = np.sqrt(np.diag(cross)[1:] / n)
    sd[sd == 0] = 1.0
    gram = cross[1:, 1:] / n / np.outer(sd, sd)
    right = cross[1:, 0] / n / sd
    if lambdas is None:
        top = np.abs(right).max() / max(alpha, 1e-3)
        lambdas = np.exp(np.linspace(np.log(top), np.log(top * 1e-4), 50))
    b, out = np.zeros(len(right)), []
    for lam in lambdas:
        b = _descent(gram, right, lam, alpha, b)
        out.append(b / sd)
    out = np.array(out)
    return lambdas, out, mean[0] - out @ mean[1:]


def elastic_net(formula: str, df: DataFrame, alpha: float = 0.5, lambdas=None) -> Path:
    """The elastic net's path over standardised regressors, from one centred cross product."""
    made = design(df, Formula.parse(formula))
    rows, names = complete(df, made)
    n, mean, cross = moments(rows, names)
    return Path(made.names, *_path(n, mean, cross, alpha, None if lambdas is None else np.atleast_1d(np.asarray(lambdas, float))))


def lasso(formula: str, df: DataFrame, lambdas=None) -> Path:
    return elastic_net(formula, df, 1.0, lambdas)


def ridge(formula: str, df: DataFrame, lambdas=None) -> Path:
    return elastic_net(formula, df, 0.0, lambdas)


def cv_glmnet(formula: str, df: DataFrame, alpha: float = 1.0, folds: int = 5, fold_by: str | None = None) -> Path:
    """Cross-validated path; the folds' cross products come from one pass, and a fold's training set is the rest.

    ``fold_by`` names a whole-number column whose remainder is the fold;
    without it a hash of the row decides.
    """
    made = design(df, Formula.parse(formula))
    rows, names = complete(df, made, (fold_by,) if fold_by else ())
    part = F.pmod(F.col(fold_by).cast("long"), F.lit(folds)) if fold_by else F.pmod(F.xxhash64(*names), F.lit(folds))
    rows = rows.withColumn("__f", part)
    p = len(names)

    def run(m):
        out = np.zeros((folds, p + 1, p + 1))
        for k in range(folds):
            own = m[m[:, -1] == k, :-1]
            one = np.column_stack([np.ones(len(own)), own])
            out[k] = one.T @ one
        return out.ravel()

    parts = fold(rows, [*names, "__f"], run).reshape(folds, p + 1, p + 1)

    def centred(t):
        n, mean = t[0, 0], t[0, 1:] / t[0, 0]
        return n, mean, t[1:, 1:] - n * np.outer(mean, mean)

    whole = parts.sum(axis=0)
    lambdas, coefs, intercepts = _path(*centred(whole), alpha, None)
    errors = np.zeros((folds, len(lambdas)))
    for k in range(folds):
        _, b, b0 = _path(*centred(whole - parts[k]), alpha, lambdas)
        for i in range(len(lambdas)):
            v = np.concatenate([[-b0[i], 1.0], -b[i]])
            errors[k, i] = v @ parts[k] @ v / parts[k][0, 0]
    mean, se = errors.mean(axis=0), errors.std(axis=0, ddof=1) / np.sqrt(folds)
    best = int(mean.argmin())
    within = np.flatnonzero(mean <= mean[best] + se[best])[0]
    return Path(made.names, lambdas, coefs, intercepts, mean, se, float(lambdas[best]), float(lambdas[within]))


def anova(model: Fit) -> list[dict]:
    """Model against residual sum of squares."""
    k, s = len(model.names) - 1, model.stats
    ss = s["tss"] - s["rss"]
    f = ss / k / (s["rss"] / model.df_resid)
    return [dict(source="model", df=k, sum_sq=ss, mean_sq=ss / k, f_value=f, p_value=float(1 - D.fisher_f(k, model.df_resid).cdf(f))), dict(source="residual", df=model.df_resid, sum_sq=s["rss"], mean_sq=s["rss"] / model.df_resid, f_value=None, p_value=None)]
