"""Time series: lag moments in one aggregate; recursions run per series, many series in parallel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StatError
from ..functions import distributions as D


def _w(order: str, by: Sequence[str]):
    return Window.partitionBy(*by).orderBy(order)


def difference(df: DataFrame, value: str, order: str, d: int = 1, by: Sequence[str] = (), to: str = "diff") -> DataFrame:
    out, name = df, value
    for _ in range(d):
        out = out.withColumn(to, F.col(name) - F.lag(name).over(_w(order, by)))
        name = to
    return out


def acf(df: DataFrame, value: str, order: str, lags: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """lag and acf (per series): autocovariance over variance, both around the series' mean."""
    means = df.groupBy(*by).agg(F.avg(value).alias("__m"))
    centred = (df.join(means, list(by)) if by else df.crossJoin(F.broadcast(means))).withColumn("__x", F.col(value) - F.col("__m"))
    shifted = centred.select(*by, "__x", *[F.lag("__x", k).over(_w(order, by)).alias(f"__l{k}") for k in range(1, lags + 1)])
    sums = shifted.groupBy(*by).agg(F.sum(F.col("__x") * F.col("__x")).alias("c0"), *[F.sum(F.col("__x") * F.col(f"__l{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"c{k}") / F.col("c0")).alias("acf")) for k in range(lags + 1)])
    return sums.select(*by, F.explode(cells).alias("x")).select(*by, "x.lag", "x.acf")


def _one_acf(df, value, order, lags) -> np.ndarray:
    return np.array([r.acf if r.acf is not None else np.nan for r in acf(df, value, order, lags).orderBy("lag").collect()])


def pacf(df: DataFrame, value: str, order: str, lags: int = 10) -> np.ndarray:
    """Partial autocorrelations by the Durbin-Levinson recursion."""
    r = _one_acf(df, value, order, lags)
    phi, out = np.zeros(0), [1.0]
    for k in range(1, lags + 1):
        a = (r[k] - phi @ r[k - 1 : 0 : -1][: len(phi)]) / (1 - phi @ r[1 : len(phi) + 1]) if k > 1 else r[1]
        phi = np.append(phi - a * phi[::-1], a)
        out.append(a)
    return np.array(out)


def ljung_box(df: DataFrame, value: str, order: str, lags: int = 10) -> dict:
    r, n = _one_acf(df, value, order, lags), df.filter(F.col(value).isNotNull()).count()
    q = n * (n + 2) * sum(r[k] ** 2 / (n - k) for k in range(1, lags + 1))
    return dict(statistic=float(q), df=lags, p_value=float(1 - D.chisq(lags).cdf(q)))


def adf(df: DataFrame, value: str, order: str, lags: int = 0) -> dict:
    """Dickey-Fuller regression with intercept and ``lags`` lagged differences; compared with the 1, 5 and 10 % critical values."""
    from .linear import ols

    w = _w(order, ())
    x = difference(df, value, order, 1, (), "__d").withColumn("__l", F.lag(value).over(w))
    for k in range(1, lags + 1):
        x = x.withColumn(f"__d{k}", F.lag("__d", k).over(w))
    fit = ols("__d ~ " + " + ".join(["__l", *[f"__d{k}" for k in range(1, lags + 1)]]), x)
    t, n = fit.tidy()[1]["statistic"], fit.n
    # fixed values: response surface of the critical values for a regression with intercept
    critical = {"1%": -3.43035 - 6.5393 / n - 16.786 / n**2, "5%": -2.86154 - 2.8903 / n - 4.234 / n**2, "10%": -2.56677 - 1.5384 / n - 2.809 / n**2}
    return dict(statistic=t, n=n, critical=critical, stationary=t < critical["5%"])


def decompose(df: DataFrame, value: str, index: str, period: int, by: Sequence[str] = ()) -> DataFrame:
    """Additive trend (centred moving average), seasonal means that sum to zero, and remainder; ``index`` counts 0, 1, ..."""
    w = _w(index, by)
    h = period // 2
    inner = F.sum(value).over(w.rowsBetween(-h, h))
    if period % 2 == 0:
        inner = inner - 0.5 * (F.lag(value, h).over(w) + F.lead(value, h).over(w))
    whole = F.lag(value, h).over(w).isNotNull() & F.lead(value, h).over(w).isNotNull()
    with_trend = df.withColumn("trend", F.when(whole, inner / period)).withColumn("season", F.pmod(F.col(index).cast("long"), F.lit(period)))
    raw = with_trend.groupBy(*by, "season").agg(F.avg(F.col(value) - F.col("trend")).alias("__s"))
    centre = raw.groupBy(*by).agg(F.avg("__s").alias("__c"))
    seasonal = (raw.join(centre, list(by)) if by else raw.crossJoin(F.broadcast(centre))).select(*by, "season", (F.col("__s") - F.col("__c")).alias("seasonal"))
    out = with_trend.join(F.broadcast(seasonal) if not by else seasonal, [*by, "season"])
    return out.withColumn("remainder", F.col(value) - F.col("trend") - F.col("seasonal"))


def ar(df: DataFrame, value: str, order: str, p: int = 1, d: int = 0) -> dict:
    """Autoregression of the d-th difference by Yule-Walker equations."""
    x = difference(df, value, order, d, (), "__d") if d else df.withColumn("__d", F.col(value))
    x = x.filter(F.col("__d").isNotNull())
    n, mean, var = x.agg(F.count("__d"), F.avg("__d"), F.var_pop("__d")).collect()[0]
    if n <= p + 1:
        raise StatError("S0201", "the series is too short")
    r = _one_acf(x, "__d", order, max(p, 1))
    toeplitz = np.array([[r[abs(i - j)] for j in range(p)] for i in range(p)])
    phi = np.linalg.solve(toeplitz, r[1 : p + 1]) if p else np.zeros(0)
    s2 = var * (1 - phi @ r[1 : p + 1]) if p else var
    loglik = -0.5 * n * (np.log(2 * np.pi * s2) + 1)
    tail = [t[0] for t in x.orderBy(F.desc(order)).limit(max(p, 1)).select("__d").collect()][::-1]
    last = df.filter(F.col(value).isNotNull()).orderBy(F.desc(order)).limit(max(d, 1)).select(value).collect()
    return dict(p=p, d=d, phi=phi, mean=mean, sigma2=float(s2), log_lik=float(loglik), aic=float(-2 * loglik + 2 * (p + 2)), n=n, tail=tail, last=[t[0] for t in last][::-1])


def forecast(model: dict, steps: int, level: float = 0.95) -> list[dict]:
    """Recursive forecasts with limits; one difference is undone."""
    if model["d"] > 1:
        raise StatError("S0203", "forecasts undo at most one difference")
    seen, phi, out = [v - model["mean"] for v in model["tail"]], model["phi"], []
    psi, total, q = [1.0], model["last"][-1], float(D.normal().quantile(0.5 + level / 2))
    for h in range(steps):
        nxt = float(sum(phi[k] * seen[-1 - k] for k in range(len(phi))))
        seen.append(nxt)
        psi.append(float(sum(phi[k] * psi[-1 - k] for k in range(min(len(phi), len(psi))))))
        value = nxt + model["mean"]
        weights = np.cumsum(psi[: h + 1]) if model["d"] else np.array(psi[: h + 1])
        total = total + value
        point, se = (total if model["d"] else value), float(np.sqrt(model["sigma2"] * (weights**2).sum()))
        out.append(dict(step=h + 1, forecast=point, conf_low=point - q * se, conf_high=point + q * se))
    return out


def auto_ar(df: DataFrame, value: str, order: str, most: int = 4, d: int = 0) -> dict:
    """The order with the least AIC."""
    return min((ar(df, value, order, p, d) for p in range(most + 1)), key=lambda m: m["aic"])


def _per_series(df, by, run, schema):
    """Apply ``run`` to each series in order; one series is one task's work, since each value needs the one before."""
    keys = list(by) or [F.lit("all").alias("__series")]
    return df.groupBy(*keys).applyInPandas(run, schema)


def holt_winters(df: DataFrame, value: str, order: str, period: int, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Additive triple smoothing: level, trend, seasonal and one-step fit of each row."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(order)
        y = x[value].to_numpy(float)
        m = min(period, len(y))
        level, season = y[:m].mean(), list(y[:m] - y[:m].mean())
        trend = (y[m : 2 * m].mean() - level) / m if len(y) >= 2 * m else 0.0
        rows = []
        for i, v in enumerate(y):
            s = season[i % m]
            fitted = level + trend + s
            new = alpha * (v - s) + (1 - alpha) * (level + trend)
            trend = beta * (new - level) + (1 - beta) * trend
            season[i % m] = gamma * (v - new) + (1 - gamma) * s
            level = new
            rows.append((level, trend, season[i % m], fitted))
        return x.assign(**dict(zip(("level", "trend", "seasonal", "fitted"), np.array(rows).T)))

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", level double, trend double, seasonal double, fitted double"
    return _per_series(df, by, run, schema)


def kalman(df: DataFrame, value: str, order: str, q: float, r: float, by: Sequence[str] = (), smooth: bool = True) -> DataFrame:
    """Local level model: filtered and, by Rauch-Tung-Striebel, smoothed states and variances; missing values are only predicted."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(order)
        y = x[value].to_numpy(float)
        n = len(y)
        m, p = np.empty(n), np.empty(n)
        there = y[~np.isnan(y)]
        state, var = (there[0] if len(there) else 0.0), r + q
        for i, v in enumerate(y):
            var = var + q
            if not np.isnan(v):
                gain = var / (var + r)
                state, var = state + gain * (v - state), (1 - gain) * var
            m[i], p[i] = state, var
        sm, sp = m.copy(), p.copy()
        for i in range(n - 2, -1, -1) if smooth else ():
            c = p[i] / (p[i] + q)
            sm[i], sp[i] = m[i] + c * (sm[i + 1] - m[i]), p[i] + c * c * (sp[i + 1] - p[i] - q)
        return x.assign(filtered=m, filtered_var=p, smoothed=sm, smoothed_var=sp)

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", filtered double, filtered_var double, smoothed double, smoothed_var double"
    return _per_series(df, by, run, schema)


def garch(df: DataFrame, value: str, order: str, asymmetric: bool = False) -> dict:
    """GARCH(1,1), or with a leverage term, by maximum likelihood over one series that fits into memory."""
    from .optimize import minimize

    y = np.array([t[0] for t in df.filter(F.col(value).isNotNull()).orderBy(order).select(F.col(value).cast("double")).collect()])
    y = y - y.mean()
    target = y.var()

    def unpack(t):
        a, g, b = (1 / (1 + np.exp(-v)) for v in (t[0], t[2] if asymmetric else -50, t[1]))
        b = b * (1 - a - 0.5 * g * (1 - a))
        return a, g * (1 - a), b

    def path(t):
        a, g, b = unpack(t)
        omega = max(target * (1 - a - 0.5 * g - b), 1e-12)
        h = np.empty(len(y))
        h[0] = target
        for i in range(1, len(y)):
            h[i] = omega + (a + g * (y[i - 1] < 0)) * y[i - 1] ** 2 + b * h[i - 1]
        return h

    def loss(t):
        h = path(t)
        return 0.5 * float((np.log(2 * np.pi * h) + y**2 / h).sum())

    best = minimize(loss, np.array([-2.5, 2.0, -3.0][: 3 if asymmetric else 2]), method="nelder-mead", max_iter=400)
    a, g, b = unpack(best["par"])
    h = path(best["par"])
    return dict(alpha=float(a), gamma=float(g), beta=float(b), omega=float(target * (1 - a - 0.5 * g - b)), log_lik=-best["value"], volatility=np.sqrt(h), next_variance=float(target * (1 - a - 0.5 * g - b) + (a + g * (y[-1] < 0)) * y[-1] ** 2 + b * h[-1]))


def risk_metrics(df: DataFrame, value: str, level: float = 0.95) -> dict:
    """Historical value at risk and expected shortfall of returns."""
    cut = df.agg(F.percentile(value, F.lit(1 - level))).collect()[0][0]
    tail = df.filter(F.col(value) <= cut).agg(F.avg(value)).collect()[0][0]
    return dict(value_at_risk=-cut, expected_shortfall=-tail)


def granger(df: DataFrame, cause: str, effect: str, order: str, lags: int = 1) -> dict:
    """F test of the cause's lags in a regression on the effect's own lags."""
    from .linear import ols

    w = _w(order, ())
    x = df
    for k in range(1, lags + 1):
        x = x.withColumn(f"__e{k}", F.lag(effect, k).over(w)).withColumn(f"__c{k}", F.lag(cause, k).over(w))
    x = x.filter(F.col(f"__e{lags}").isNotNull() & F.col(f"__c{lags}").isNotNull())
    own = [f"__e{k}" for k in range(1, lags + 1)]
    small, big = ols(f"{effect} ~ {' + '.join(own)}", x), ols(f"{effect} ~ {' + '.join([*own, *[f'__c{k}' for k in range(1, lags + 1)]])}", x)
    f = (small.stats["rss"] - big.stats["rss"]) / lags / (big.stats["rss"] / big.df_resid)
    return dict(statistic=float(f), df1=lags, df2=big.df_resid, p_value=float(1 - D.fisher_f(lags, big.df_resid).cdf(f)))


def var_model(df: DataFrame, columns: Sequence[str], order: str, lags: int = 1) -> dict:
    """Vector autoregression: one regression per column on all columns' lags."""
    from .linear import ols

    w, x = _w(order, ()), df
    terms = []
    for k in range(1, lags + 1):
        for c in columns:
            x = x.withColumn(f"{c}_l{k}", F.lag(c, k).over(w))
            terms.append(f"{c}_l{k}")
    fits = {c: ols(f"{c} ~ {' + '.join(terms)}", x) for c in columns}
    return dict(names=["(Intercept)", *terms], coef={c: f.coef for c, f in fits.items()}, sigma={c: f.stats["sigma"] for c, f in fits.items()}, aic=sum(f.stats["aic"] for f in fits.values()))
