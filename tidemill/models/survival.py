"""Survival curves and tests from counts per time; the risk sets are running sums over the distinct times."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StatError
from ..functions import distributions as D
from .fold import fold


def life_table(df: DataFrame, time: str, event: str, group: str | None = None) -> DataFrame:
    """time, events d, censored c and number at risk n, per distinct time (and group)."""
    by = [group] if group else []
    rows = df.filter(F.col(time).isNotNull() & F.col(event).isNotNull())
    counts = rows.groupBy(*by, F.col(time).cast("double").alias("time")).agg(F.sum((F.col(event) > 0.5).cast("long")).alias("d"), F.count(F.lit(1)).alias("m"))
    later = Window.partitionBy(*by).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("n", F.sum("m").over(later)).select(*by, "time", "d", (F.col("m") - F.col("d")).alias("c"), "n")


def kaplan_meier(df: DataFrame, time: str, event: str, group: str | None = None) -> DataFrame:
    """Product-limit estimate at event times with Greenwood errors and 95 % limits within [0, 1]."""
    by = [group] if group else []
    w = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = life_table(df, time, event, group).filter("d > 0")
    # a factor of zero ends the curve; the others multiply as sums of logarithms
    gone = F.max((F.col("d") == F.col("n")).cast("int")).over(w)
    logs = F.sum(F.ln(F.when(F.col("d") < F.col("n"), 1 - F.col("d") / F.col("n")))).over(w)
    s = F.when(gone == 1, 0.0).otherwise(F.exp(logs))
    greenwood = F.sum(F.when(F.col("d") < F.col("n"), F.col("d") / (F.col("n") * (F.col("n") - F.col("d"))))).over(w)
    out = t.withColumn("survival", s).withColumn("std_error", F.col("survival") * F.sqrt(F.coalesce(greenwood, F.lit(0.0))))
    half = 1.96 * F.col("std_error")
    return out.withColumn("conf_low", F.greatest(F.lit(0.0), F.col("survival") - half)).withColumn("conf_high", F.least(F.lit(1.0), F.col("survival") + half))


def median_survival(curve: DataFrame) -> float | None:
    """The first time at which the curve is at one half or below."""
    return curve.filter("survival <= 0.5").agg(F.min("time")).collect()[0][0]


def nelson_aalen(df: DataFrame, time: str, event: str, group: str | None = None) -> DataFrame:
    by = [group] if group else []
    w = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = life_table(df, time, event, group).filter("d > 0")
    return t.withColumn("hazard", F.sum(F.col("d") / F.col("n")).over(w)).withColumn("std_error", F.sqrt(F.sum(F.col("d") / (F.col("n") * F.col("n"))).over(w)))


def logrank(df: DataFrame, time: str, event: str, group: str) -> dict:
    """Two groups (``group`` above one half, or not) by hypergeometric variances."""
    g = (F.col(group) > 0.5).cast("long")
    rows = df.filter(F.col(time).isNotNull() & F.col(event).isNotNull() & F.col(group).isNotNull())
    counts = rows.groupBy(F.col(time).cast("double").alias("time")).agg(
        F.sum((F.col(event) > 0.5).cast("long")).alias("d"), F.sum((F.col(event) > 0.5).cast("long") * g).alias("d1"), F.count(F.lit(1)).alias("m"), F.sum(g).alias("m1")
    )
    later = Window.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = counts.withColumn("n", F.sum("m").over(later)).withColumn("n1", F.sum("m1").over(later)).filter("d > 0")
    v = F.when(F.col("n") > 1, F.col("d") * (F.col("n1") / F.col("n")) * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    o, e, var = t.agg(F.sum("d1"), F.sum(F.col("d") * F.col("n1") / F.col("n")), F.sum(v)).collect()[0]
    if not var:
        raise StatError("S0202", "the groups can't be compared")
    chi = (o - e) ** 2 / var
    return dict(observed=o, expected=e, variance=var, statistic=chi, p_value=float(1 - D.chisq(1).cdf(chi)))


def cox(df: DataFrame, time: str, event: str, covariates: list[str], rounds: int = 25, tol: float = 1e-8) -> dict:
    """Proportional hazards by Newton's method with Breslow's ties.

    Each round sums exp(xb), its products with x and with xx per distinct time;
    the risk sets' sums are running sums over these times.
    """
    rows = df.select(F.col(time).cast("double").alias("t"), (F.col(event) > 0.5).cast("double").alias("e"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)]).dropna()
    p = len(covariates)
    n, *sums = fold(rows, [f"x{i}" for i in range(p)], lambda m: np.append(len(m), m.sum(axis=0)))
    rows = rows.select("t", "e", *[(F.col(f"x{i}") - float(s / max(n, 1))).alias(f"x{i}") for i, s in enumerate(sums)])
    beta, before = np.zeros(p), None
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    later = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def derivatives(b):
        eta = sum((F.lit(float(v)) * F.col(f"x{i}") for i, v in enumerate(b)), F.lit(0.0))
        r = F.exp(eta)
        aggs = [F.sum("e").alias("d"), F.sum(r).alias("s0"), F.sum(F.col("e") * eta).alias("le")]
        aggs += [F.sum(r * F.col(f"x{i}")).alias(f"s{i}_") for i in range(p)] + [F.sum(F.col("e") * F.col(f"x{i}")).alias(f"e{i}") for i in range(p)]
        aggs += [F.sum(r * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in pairs]
        at = rows.groupBy("t").agg(*aggs)
        run = {c: F.sum(c).over(later) for c in ["s0", *[f"s{i}_" for i in range(p)], *[f"q{i}_{j}" for i, j in pairs]]}
        risk = at.withColumns(run).filter("d > 0")
        d, s0 = F.col("d"), F.col("s0")
        out = risk.agg(F.sum(F.col("le") - d * F.ln(s0)), *[F.sum(F.col(f"e{i}") - d * F.col(f"s{i}_") / s0) for i in range(p)], *[F.sum(d * (F.col(f"q{i}_{j}") / s0 - F.col(f"s{i}_") * F.col(f"s{j}_") / s0 / s0)) for i, j in pairs]).collect()[0]
        if out[0] is None:
            raise StatError("S0202", "no events")
        info = np.zeros((p, p))
        for v, (i, j) in zip(out[1 + p :], pairs):
            info[i, j] = info[j, i] = v
        return float(out[0]), np.array(out[1 : 1 + p]), info

    for step in range(1, rounds + 1):
        loglik, score, info = derivatives(beta)
        before = loglik if before is None else before
        move = np.linalg.solve(info, score)
        beta = beta + move
        if np.abs(move).max() < tol:
            break
    loglik, _, info = derivatives(beta)
    cov = np.linalg.inv(info)
    lrt = 2 * (loglik - before)
    return dict(names=covariates, coef=beta, std_error=np.sqrt(np.diag(cov)), hazard_ratio=np.exp(beta), log_lik=loglik, lrt=lrt, lrt_p_value=float(1 - D.chisq(p).cdf(lrt)), iterations=step)


def weibull(df: DataFrame, time: str, event: str) -> dict:
    """Shape and scale by regressing ln(-ln S) on ln t over the product-limit curve."""
    curve = kaplan_meier(df, time, event).filter("survival > 0 and survival < 1 and time > 0").select(F.ln("time").alias("x"), F.ln(-F.ln("survival")).alias("y"))
    slope, intercept, n = curve.agg(F.regr_slope("y", "x"), F.regr_intercept("y", "x"), F.count(F.lit(1))).collect()[0]
    if n < 2:
        raise StatError("S0202", "too few event times")
    return dict(shape=slope, scale=float(np.exp(-intercept / slope)))
