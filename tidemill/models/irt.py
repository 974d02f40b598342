"""Item response models by marginal maximum likelihood over response patterns, scoring, fit and differential functioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StatError
from ..functions import distributions as D
from .fold import fold
from .optimize import minimize


def quadrature(points: int = 31, reach: float = 4.5) -> tuple[np.ndarray, np.ndarray]:
    x = np.linspace(-reach, reach, points)
    w = np.exp(-0.5 * x * x)
    return x, w / w.sum()


def probability(theta, a, b, c=0.0, d=1.0):
    """Four-parameter logistic item response."""
    return c + (d - c) / (1 + np.exp(-np.clip(a * (theta - b), -50, 50)))


def _patterns(df: DataFrame, items: list[str]) -> DataFrame:
    """Distinct response patterns with counts: as many rows as patterns, wherever the persons are."""
    return df.select(*items).groupBy(*items).agg(F.count(F.lit(1)).alias("__n")).persist()


def fit_dichotomous(df: DataFrame, items: list[str], model: str = "2pl", rounds: int = 200, tol: float = 1e-4, points: int = 31) -> dict:
    """1pl, 2pl, 3pl or 4pl by expectation maximisation; missing answers are left out of a person's likelihood."""
    table, j = _patterns(df, items), len(items)
    x, w = quadrature(points)
    a, b, c, d = np.ones(j), np.zeros(j), np.full(j, 0.15 if model in ("3pl", "4pl") else 0.0), np.full(j, 0.98 if model == "4pl" else 1.0)

    def expected(m):
        y, n = m[:, :-1], m[:, -1]
        p = probability(x[:, None], a, b, c, d).clip(1e-9, 1 - 1e-9)
        there = ~np.isnan(y)
        y0 = np.where(there, y, 0.0)
        ll = y0 @ np.log(p).T + (there * (1 - y0)) @ np.log1p(-p).T + np.log(w)
        top = ll.max(axis=1, keepdims=True) if len(m) else np.zeros((0, 1))
        total = top + np.log(np.exp(ll - top).sum(axis=1, keepdims=True))
        post = np.exp(ll - total) * n[:, None]
        return np.concatenate([(post.T @ (there * y0)).ravel(), (post.T @ there).ravel(), [(n * total[:, 0]).sum(), n.sum()]])

    last = -np.inf
    for step in range(1, rounds + 1):
        out = fold(table, [*items, "__n"], expected)
        r, n = out[: points * j].reshape(points, j), out[points * j : 2 * points * j].reshape(points, j)
        loglik, persons = float(out[-2]), out[-1]
        if persons < 2:
            raise StatError("S0202", "too few persons")
        if model == "1pl":
            for _ in range(20):  # one common slope
                p = probability(x[:, None], a, b)
                v = n * p * (1 - p)
                b = b + np.clip(-(r - n * p).sum(axis=0) / np.maximum((a * v).sum(axis=0), 1e-9), -0.5, 0.5)
                z = x[:, None] - b
                a = np.full(j, np.clip(a[0] + np.clip(((r - n * p) * z).sum() / max((v * z * z).sum(), 1e-9), -0.2, 0.2), 0.05, 6))
        else:
            for i in range(j):
                if model == "2pl":
                    for _ in range(10):
                        p = probability(x, a[i], b[i])
                        e, v, z = r[:, i] - n[:, i] * p, n[:, i] * p * (1 - p), x
                        g = np.array([(e * z).sum(), e.sum()])  # in slope and intercept
                        h = np.array([[(v * z * z).sum(), (v * z).sum()], [(v * z).sum(), v.sum()]]) + 1e-9 * np.eye(2)
                        s = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
                        slope, cut = np.clip(a[i] + s[0], 0.05, 6), -a[i] * b[i] + s[1]
                        a[i], b[i] = slope, np.clip(-cut / slope, -6, 6)
                        if np.abs(s).max() < 1e-6:
                            break
                else:
                    def loss(t, i=i):
                        cc, dd = 0.5 / (1 + np.exp(-t[2])), (1 - 0.3 / (1 + np.exp(-t[3]))) if model == "4pl" else 1.0
                        p = probability(x, np.exp(t[0]), t[1], cc, dd).clip(1e-9, 1 - 1e-9)
                        prior = 0.5 * (t[0] / 0.5) ** 2 + 0.5 * (t[1] / 2) ** 2 + 0.5 * ((t[2] + 0.8) / 0.8) ** 2 + (0.5 * ((t[3] + 2.6) / 0.8) ** 2 if model == "4pl" else 0)
                        return -(r[:, i] * np.log(p) + (n[:, i] - r[:, i]) * np.log1p(-p)).sum() + prior

                    start = [np.log(a[i]), b[i], np.log(c[i] / (0.5 - c[i])), *([np.log((1 - d[i]) / (0.3 - 1 + d[i]))] if model == "4pl" else [])]
                    t = minimize(loss, start, max_iter=30)["par"]
                    a[i], b[i], c[i] = np.exp(t[0]), t[1], 0.5 / (1 + np.exp(-t[2]))
                    d[i] = 1 - 0.3 / (1 + np.exp(-t[3])) if model == "4pl" else 1.0
        if abs(loglik - last) < tol * max(1.0, abs(last)) * 1e-2:
            break
        last = loglik
    free = {"1pl": j + 1, "2pl": 2 * j, "3pl": 3 * j, "4pl": 4 * j}[model]
    return dict(model=model, items=items, a=a, b=b, c=c, d=d, log_lik=loglik, aic=-2 * loglik + 2 * free, bic=-2 * loglik + np.log(persons) * free, n=int(persons), iterations=step)


def score_persons(df: DataFrame, fit: dict, points: int = 61) -> DataFrame:
    """Expected a posteriori abilities with standard errors, and the standardised person-fit statistic Zh."""
    items = fit["items"]
    x, w = quadrature(points)
    p = probability(x[:, None], fit["a"], fit["b"], fit["c"], fit["d"]).clip(1e-9, 1 - 1e-9)

    def run(batches):
        for m in batches:
            y = m[items].to_numpy(float)
            there = ~np.isnan(y)
            y0 = np.where(there, y, 0.0)
            ll = y0 @ np.log(p).T + (there * (1 - y0)) @ np.log1p(-p).T + np.log(w)
            post = np.exp(ll - ll.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            theta = post @ x
            q = probability(theta[:, None], fit["a"], fit["b"], fit["c"], fit["d"]).clip(1e-9, 1 - 1e-9)
            l0 = (there * (y0 * np.log(q) + (1 - y0) * np.log1p(-q))).sum(axis=1)
            mean = (there * (q * np.log(q) + (1 - q) * np.log1p(-q))).sum(axis=1)
            var = (there * q * (1 - q) * np.log(q / (1 - q)) ** 2).sum(axis=1)
            yield m.assign(theta=theta, std_error=np.sqrt(np.maximum(post @ x**2 - theta**2, 0)), zh=(l0 - mean) / np.sqrt(np.maximum(var, 1e-12)))

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", theta double, std_error double, zh double"
    return df.mapInPandas(run, schema)


def item_information(fit: dict, theta: np.ndarray) -> np.ndarray:
    """Information of each item at each ability."""
    t = np.asarray(theta, float)[:, None]
    p = probability(t, fit["a"], fit["b"], fit["c"], fit["d"])
    slope = fit["a"] * (p - fit["c"]) * (fit["d"] - p) / (fit["d"] - fit["c"])
    return slope**2 / (p * (1 - p))


def graded_probabilities(theta, a, cuts):
    """Category probabilities of Samejima's graded model."""
    above = np.column_stack([np.ones(len(theta)), *[probability(theta, a, b) for b in cuts], np.zeros(len(theta))])
    return above[:, :-1] - above[:, 1:]


def partial_credit_probabilities(theta, a, steps):
    """Category probabilities of the generalised partial credit model."""
    z = np.cumsum(np.column_stack([np.zeros(len(theta)), *[a * (theta - b) for b in steps]]), axis=1)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_polytomous(df: DataFrame, items: list[str], model: str = "graded", rounds: int = 60, tol: float = 1e-6, points: int = 21) -> dict:
    """Graded response or generalised partial credit (``gpcm``; ``pcm`` with slopes of one) by expectation maximisation; categories count from 0."""
    table, j = _patterns(df, items), len(items)
    most = [int(v) for v in table.agg(*[F.max(c) for c in items]).collect()[0]]
    x, w = quadrature(points)
    curve = graded_probabilities if model == "graded" else partial_credit_probabilities
    a, cuts = np.ones(j), [np.linspace(-1, 1, k) if k > 1 else np.zeros(1) for k in most]
    k = max(most) + 1
    last = -np.inf
    for step in range(1, rounds + 1):
        logs = np.full((j, points, k), 0.0)
        for i in range(j):
            logs[i, :, : most[i] + 1] = np.log(curve(x, a[i], cuts[i]).clip(1e-9))

        def expected(m):
            y, n = m[:, :-1], m[:, -1]
            there = ~np.isnan(y)
            code = np.where(there, y, 0).astype(int)
            ll = np.tile(np.log(w), (len(m), 1))
            for i in range(j):
                ll = ll + np.where(there[:, i, None], logs[i][:, code[:, i]].T, 0.0)
            top = ll.max(axis=1, keepdims=True) if len(m) else np.zeros((0, 1))
            total = top + np.log(np.exp(ll - top).sum(axis=1, keepdims=True))
            post = np.exp(ll - total) * n[:, None]
            counts = np.zeros((j, points, k))
            for i in range(j):
                for v in range(most[i] + 1):
                    counts[i, :, v] = post[there[:, i] & (code[:, i] == v)].sum(axis=0)
            return np.append(counts.ravel(), (n * total[:, 0]).sum())

        out = fold(table, [*items, "__n"], expected)
        counts, loglik = out[:-1].reshape(j, points, k), float(out[-1])
        for i in range(j):
            def loss(t, i=i):
                slope = 1.0 if model == "pcm" else np.exp(t[0])
                b = t[1] + np.concatenate([[0], np.cumsum(np.exp(t[2:]))]) if model == "graded" else t[1:]
                return -(counts[i, :, : most[i] + 1] * np.log(curve(x, slope, b).clip(1e-9))).sum() + 0.01 * (t @ t)

            b = cuts[i]
            start = [np.log(a[i]), b[0], *np.log(np.maximum(np.diff(b), 1e-2))] if model == "graded" else [np.log(a[i]), *b]
            t = minimize(loss, start, max_iter=25)["par"]
            a[i] = 1.0 if model == "pcm" else np.exp(t[0])
            cuts[i] = t[1] + np.concatenate([[0], np.cumsum(np.exp(t[2:]))]) if model == "graded" else t[1:]
        if abs(loglik - last) < tol * max(1.0, abs(last)):
            break
        last = loglik
    return dict(model=model, items=items, a=a, cuts=cuts, log_lik=loglik, iterations=step)


def mantel_haenszel_dif(df: DataFrame, items: list[str], group: str, ability: str, strata: int = 5) -> DataFrame:
    """Odds ratio of each 0/1 item between the groups (above one half or not) within ability strata over [-2.5, 2.5), with its class."""
    width = 5.0 / strata
    s = F.greatest(F.lit(0), F.least(F.lit(strata - 1), F.floor((F.col(ability) + 2.5) / width))).cast("int")
    cells = F.array(*[F.struct(F.lit(i).alias("item"), F.col(i).cast("double").alias("y")) for i in items])
    long = df.select((F.col(group) > 0.5).alias("focal"), s.alias("stratum"), F.explode(cells).alias("x")).select("focal", "stratum", "x.item", "x.y").filter("y is not null and focal is not null")
    one = lambda focal, right: F.sum(F.when((F.col("focal") == focal) & (F.col("y") == right), 1.0).otherwise(0.0))
    t = long.groupBy("item", "stratum").agg(one(False, 1).alias("a"), one(False, 0).alias("b"), one(True, 1).alias("c"), one(True, 0).alias("d"), F.count(F.lit(1)).alias("n"))
    ratio = F.sum(F.col("a") * F.col("d") / F.col("n")) / F.sum(F.col("b") * F.col("c") / F.col("n"))
    out = t.groupBy("item").agg(ratio.alias("odds_ratio"))
    delta = -2.35 * F.ln("odds_ratio")
    return out.withColumn("delta", delta).withColumn("class", F.when(F.abs(delta) < 1, "A").when(F.abs(delta) < 1.5, "B").otherwise("C"))


def q3_residuals(df: DataFrame, fit: dict) -> np.ndarray:
    """Correlations of item residuals given the abilities."""
    scored = score_persons(df, fit)
    items = fit["items"]
    j = len(items)

    def run(m):
        e = m[:, :-1] - probability(m[:, -1:], fit["a"], fit["b"], fit["c"], fit["d"])
        e = np.nan_to_num(e)
        return np.concatenate([(e.T @ e).ravel(), e.sum(axis=0), [len(m)]])

    out = fold(scored, [*items, "theta"], run)
    n, s = out[-1], out[j * j : -1]
    cov = out[: j * j].reshape(j, j) / n - np.outer(s, s) / n**2
    sd = np.sqrt(np.diag(cov))
    return cov / np.outer(sd, sd)


def dif_lrt(df: DataFrame, items: list[str], group: str, item: str) -> dict:
    """Likelihood ratio of one item's parameters free against equal in two groups, the other items common."""
    g = F.col(group) > 0.5
    split = df.select(*[c for c in items if c != item], F.when(~g, F.col(item)).alias(f"{item}__0"), F.when(g, F.col(item)).alias(f"{item}__1"))
    common = fit_dichotomous(df, items)
    free = fit_dichotomous(split, split.columns)
    chi = max(2 * (free["log_lik"] - common["log_lik"]), 0.0)
    return dict(item=item, statistic=chi, df=2, p_value=float(1 - D.chisq(2).cdf(chi)))


def link_mean_sigma(b_from: np.ndarray, b_to: np.ndarray) -> dict:
    slope = np.std(b_to, ddof=1) / np.std(b_from, ddof=1)
    return dict(slope=float(slope), intercept=float(np.mean(b_to) - slope * np.mean(b_from)))


def link_mean_mean(a_from, a_to, b_from, b_to) -> dict:
    slope = float(np.mean(a_from) / np.mean(a_to))
    return dict(slope=slope, intercept=float(np.mean(b_to) - slope * np.mean(b_from)))


def transform_items(fit: dict, link: dict) -> dict:
    return fit | dict(a=fit["a"] / link["slope"], b=link["slope"] * fit["b"] + link["intercept"])


def simulate_cat(fit: dict, theta: float, most: int = 20, stop: float = 0.3, seed: int = 0) -> dict:
    """Adaptive test by largest information with expected a posteriori updates."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x, post = quadrature(61)
    left, asked, est, se = list(range(len(fit["a"]))), [], 0.0, 1.0
    while left and len(asked) < most and se > stop:
        info = item_information(fit, np.array([est]))[0]
        i = max(left, key=lambda k: info[k])
        left.remove(i)
        pick = lambda v: probability(theta, *v)
        y = rng.random() < pick([fit[k][i] for k in "abcd"])
        p = probability(x, *[fit[k][i] for k in "abcd"])
        post = post * (p if y else 1 - p)
        post /= post.sum()
        est = float(post @ x)
        se = float(np.sqrt(post @ x**2 - est**2))
        asked.append(fit["items"][i])
    return dict(asked=asked, theta=est, std_error=se)
