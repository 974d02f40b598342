"""Difference in differences and related estimators from grouped means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StatError
from .linear import two_sided


def did_2x2(df: DataFrame, outcome: str, treated: str, post: str) -> dict:
    """Treatment effect on the treated from four cell means."""
    rows = df.filter(F.col(outcome).isNotNull() & F.col(treated).isNotNull() & F.col(post).isNotNull())
    cells = {(r[0], r[1]): r for r in rows.groupBy((F.col(treated) > 0.5).alias("t"), (F.col(post) > 0.5).alias("p")).agg(F.avg(outcome), F.var_samp(outcome), F.count(F.lit(1))).collect()}
    if len(cells) < 4 or min(r[4] for r in cells.values()) < 2:
        raise StatError("S0202", "each cell needs two rows or more")
    m = {k: r[2] for k, r in cells.items()}
    att = (m[True, True] - m[True, False]) - (m[False, True] - m[False, False])
    se = float(np.sqrt(sum(r[3] / r[4] for r in cells.values())))
    return dict(att=att, std_error=se, statistic=att / se, p_value=float(two_sided(att / se)), conf_low=att - 1.96 * se, conf_high=att + 1.96 * se, n=sum(r[4] for r in cells.values()))


def event_study(df: DataFrame, outcome: str, treated: str, relative: str, base: int = -1) -> DataFrame:
    """Difference between arms at each relative time, less that at the base time."""
    g = df.filter(F.col(outcome).isNotNull()).groupBy(F.col(relative).cast("long").alias("k")).agg(
        *[x.alias(n) for t, s in ((True, "1"), (False, "0")) for n, x in (
            ("m" + s, F.avg(F.when((F.col(treated) > 0.5) == t, F.col(outcome)))), ("v" + s, F.var_samp(F.when((F.col(treated) > 0.5) == t, F.col(outcome)))), ("n" + s, F.count(F.when((F.col(treated) > 0.5) == t, F.col(outcome)))))]
    )
    diff = g.select("k", (F.col("m1") - F.col("m0")).alias("d"), (F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0")).alias("v"))
    ref = F.broadcast(diff.filter(F.col("k") == base).select(F.col("d").alias("d0"), F.col("v").alias("v0")))
    return diff.crossJoin(ref).select("k", (F.col("d") - F.col("d0")).alias("estimate"), F.when(F.col("k") == base, 0.0).otherwise(F.sqrt(F.col("v") + F.col("v0"))).alias("std_error"))


def parallel_trends(df: DataFrame, outcome: str, treated: str, time: str, before: float) -> dict:
    """z test of the difference of pre-period slopes between the arms."""
    rows = df.filter(F.col(time) < before)
    arms = {}
    for r in rows.groupBy((F.col(treated) > 0.5).alias("t")).agg(F.regr_slope(outcome, time), F.regr_sxx(outcome, time), F.regr_syy(outcome, time), F.count(outcome)).collect():
        arms[r[0]] = (r[1], (r[3] - r[1] ** 2 * r[2]) / max(r[4] - 2, 1) / r[2])
    if len(arms) < 2:
        raise StatError("S0202", "both arms are needed before the treatment")
    (b1, v1), (b0, v0) = arms[True], arms[False]
    z = (b1 - b0) / np.sqrt(v1 + v0)
    return dict(slope_treated=b1, slope_control=b0, difference=b1 - b0, statistic=float(z), p_value=float(two_sided(z)))


def group_time_att(df: DataFrame, outcome: str, cohort: str, time: str) -> DataFrame:
    """Effect for each first-treated cohort and time against the never treated (null or 0 cohort), from the last time before treatment."""
    cell = df.groupBy(F.coalesce(F.col(cohort).cast("long"), F.lit(0)).alias("g"), F.col(time).cast("long").alias("t")).agg(F.avg(outcome).alias("m"), F.var_samp(outcome).alias("v"), F.count(outcome).alias("n"))
    never = cell.filter("g = 0").select("t", F.col("m").alias("c"), (F.col("v") / F.col("n")).alias("cv"))
    with_c = cell.filter("g <> 0").join(never, "t").select("g", "t", (F.col("m") - F.col("c")).alias("d"), (F.col("v") / F.col("n") + F.col("cv")).alias("dv"), "n")
    w = Window.partitionBy("g")
    base = F.max(F.when(F.col("t") < F.col("g"), F.col("t"))).over(w)
    marked = with_c.withColumn("b", base)
    d0 = F.max(F.when(F.col("t") == F.col("b"), F.col("d"))).over(w)
    v0 = F.max(F.when(F.col("t") == F.col("b"), F.col("dv"))).over(w)
    out = marked.select("g", "t", (F.col("d") - d0).alias("att"), F.when(F.col("t") == F.col("b"), 0.0).otherwise(F.sqrt(F.col("dv") + v0)).alias("std_error"), "n")
    return out.filter("att is not null")


def iv_2sls(df: DataFrame, outcome: str, regressor: str, instrument: str) -> dict:
    from .linear import iv

    fitted = iv(f"{outcome} ~ {regressor} | {instrument}", df)
    return dict(**fitted.tidy()[1], **fitted.stats)


def doubly_robust(df: DataFrame, outcome: str, treated: str, covariates: list[str]) -> dict:
    """Effect on the treated: control outcomes regressed on covariates, corrected by odds-weighted residuals."""
    from .linear import logistic, ols

    terms = " + ".join(covariates)
    rows = df.select(outcome, treated, *covariates).dropna().withColumn(treated, (F.col(treated) > 0.5).cast("int"))
    score = logistic(f"{treated} ~ {terms}", rows).predict(rows, "__p")
    both = ols(f"{outcome} ~ {terms}", rows.filter(F.col(treated) == 0)).predict(score, "__m")
    e, t, r = F.greatest(F.least(F.col("__p"), F.lit(0.999)), F.lit(0.001)), F.col(treated), F.col(outcome) - F.col("__m")
    w = F.when(t == 0, e / (1 - e)).otherwise(0.0)
    n1, a, sw, b = both.agg(F.sum(t), F.sum(t * r), F.sum(w), F.sum(w * r)).collect()[0]
    att = a / n1 - b / sw
    n = both.count()
    influence = t * (r - att) / (n1 / n) - w * (r - b / sw) / (sw / n) - t * 0
    var = both.agg(F.avg(influence * influence)).collect()[0][0]
    se = float(np.sqrt(var / n))
    return dict(att=att, std_error=se, statistic=att / se, p_value=float(two_sided(att / se)), n=n)


def synthetic_control(df: DataFrame, unit: str, time: str, outcome: str, treated_unit, start: float, steps: int = 20_000) -> dict:
    """Simplex weights of the other units that fit the treated unit before ``start``; a time-by-unit matrix is the panel's size."""
    wide = df.filter(F.col(outcome).isNotNull()).groupBy(time).pivot(unit).agg(F.avg(outcome)).orderBy(time).toPandas().set_index(time).dropna(axis=1)
    wide.columns = [str(c) for c in wide.columns]  # as pivot names them
    y = wide[str(treated_unit)].to_numpy(float)
    x = wide.drop(columns=[str(treated_unit)])
    pre = wide.index.to_numpy() < start
    a, w = x.to_numpy(float)[pre], np.full(x.shape[1], 1 / x.shape[1])
    scale = max(np.abs(a.T @ a).max() / max(pre.sum(), 1), 1e-12)
    for _ in range(steps):
        grad = a.T @ (a @ w - y[pre]) / max(pre.sum(), 1) / scale
        new = w * np.exp(-0.5 * grad)
        new /= new.sum()
        if np.abs(new - w).max() < 1e-10:
            break
        w = new
    gap = y - x.to_numpy(float) @ w
    rm = lambda g: float(np.sqrt((g**2).mean())) if len(g) else float("nan")
    return dict(weights=dict(zip(x.columns, w.tolist())), gap=dict(zip(wide.index.tolist(), gap.tolist())), pre_rmspe=rm(gap[pre]), post_rmspe=rm(gap[~pre]), ratio=rm(gap[~pre]) / max(rm(gap[pre]), 1e-12), effect=float(gap[~pre].mean()) if (~pre).any() else float("nan"))


def robustness_value(t_statistic: float, df_resid: float, q: float = 1.0) -> float:
    """Share of residual variance that an unseen confounder must explain of both sides to bring the estimate down by q."""
    f = q * abs(t_statistic) / np.sqrt(df_resid)
    return float(0.5 * (np.sqrt(f**4 + 4 * f**2) - f**2))


def bacon_decompose(df: DataFrame, outcome: str, unit: str, time: str, cohort: str) -> list[dict]:
    """The two-by-two comparisons whose weighted mean is the two-way fixed-effects estimate, for a balanced panel.

    ``cohort`` is the time of first treatment, null for never. Only means and
    sizes of cohorts by time come to the driver.
    """
    rows = df.filter(F.col(outcome).isNotNull()).groupBy(F.col(cohort).cast("double").alias("g"), F.col(time).cast("double").alias("t")).agg(F.avg(outcome).alias("m"), F.count_distinct(unit).alias("n")).collect()
    times = sorted({r.t for r in rows})
    cohorts = sorted({r.g for r in rows if r.g is not None and r.g > times[0]})
    mean = {(r.g, r.t): r.m for r in rows}
    size = {r.g: r.n for r in rows}
    total = sum(size.values())
    share = {g: n / total for g, n in size.items()}
    treated = {g: sum(t >= g for t in times) / len(times) for g in cohorts}

    def step(g, low, cut, high):
        """Change of a cohort's mean from [low, cut) to [cut, high)."""
        before, after = ([mean[g, t] for t in times if a <= t < b] for a, b in ((low, cut), (cut, high)))
        return np.mean(after) - np.mean(before) if before and after else np.nan

    inf, out = float("inf"), []

    def put(kind, a, b, estimate, weight):
        if weight > 0 and estimate == estimate:
            out.append(dict(kind=kind, treated=a, control=b, estimate=float(estimate), weight=float(weight)))

    for k in cohorts:
        dk = treated[k]
        if None in size:
            both = share[k] + share[None]
            mix = share[k] / both
            put("treated vs never", k, None, step(k, -inf, k, inf) - step(None, -inf, k, inf), both**2 * mix * (1 - mix) * dk * (1 - dk))
        for later in (c for c in cohorts if c > k):
            dl, both = treated[later], share[k] + share[later]
            mix = share[k] / both
            put("earlier vs later", k, later, step(k, -inf, k, later) - step(later, -inf, k, later), (both * (1 - dl)) ** 2 * mix * (1 - mix) * (dk - dl) / (1 - dl) * (1 - dk) / (1 - dl))
            put("later vs earlier", later, k, step(later, k, later, inf) - step(k, k, later, inf), (both * dk) ** 2 * mix * (1 - mix) * dl / dk * (dk - dl) / dk)
    if not out:
        raise StatError("S0202", "no two cohorts can be compared")
    whole = sum(r["weight"] for r in out)
    return [r | dict(weight=r["weight"] / whole) for r in out]
