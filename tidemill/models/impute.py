"""Missing-data summaries and imputation."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StatError
from ..functions import distributions as D
from ..sources.scratch import cut
from .fold import fold


def missing_summary(df: DataFrame) -> DataFrame:
    """column, n, missing and percent, from one aggregate."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"m{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("missing")) for i, c in enumerate(df.columns)])
    return one.select("n", F.explode(cells).alias("x")).select("x.column", "n", "x.missing", F.when(F.col("n") > 0, 100.0 * F.col("x.missing") / F.col("n")).otherwise(0.0).alias("percent"))


def missing_columns(df: DataFrame) -> list[str]:
    return [r.column for r in missing_summary(df).filter("missing > 0").collect()]


def has_missing(df: DataFrame) -> bool:
    return bool(missing_columns(df))


def imputed_mask(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").isNull().alias(c) for c in df.columns])


def missing_patterns(df: DataFrame) -> DataFrame:
    """Row patterns of missing cells (1: missing) with counts."""
    flags = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns])
    return df.groupBy(flags.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def hotdeck(df: DataFrame, column: str, pool: str, order: Sequence[str], seed: int = 0) -> DataFrame:
    """Fill from donors of the same pool: donors and receivers are numbered and receivers take donors in turn from a seeded start."""
    there = F.col(column).isNotNull()
    number = F.row_number().over(Window.partitionBy(pool).orderBy(*order)) - 1
    donors = df.filter(there).select(pool, number.alias("__k"), F.col(column).alias("__d"))
    sizes = donors.groupBy(pool).agg(F.count(F.lit(1)).alias("__n"))
    asked = df.filter(~there).withColumn("__i", number).join(sizes, pool, "left")
    asked = asked.withColumn("__k", F.pmod(F.col("__i") + F.pmod(F.xxhash64(F.lit(seed), pool), F.col("__n")), F.col("__n")).cast("int"))
    filled = asked.join(donors, [pool, "__k"], "left").withColumn(column, F.col("__d"))
    return df.filter(there).unionByName(filled.select(df.columns))


#: Rows of one block of donors and of receivers; every block of the one meets every block of the other.
DONOR_ROWS, RECEIVER_ROWS = 16_384, 4096
#: Distances held at once.
CELLS = 1 << 20


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of doubles and longs as pickled column lists of at most ``size`` rows."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                if n + part.num_rows > size:
                    yield block(held)
                    held, n = [], 0
                held.append([c.to_numpy(zero_copy_only=False) for c in part.columns])
                n += part.num_rows
        if n:
            yield block(held)

    def block(held):
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps([np.concatenate(c) for c in zip(*held)])], pa.binary())], names=[name])

    return rows.mapInArrow(run, f"{name} binary")


def _gower(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Mean absolute difference over the features that both rows have, 1 where there is none."""
    total, valid = np.zeros((len(q), len(x))), np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        apart = np.abs(q[:, j][:, None] - x[:, j][None, :])
        there = ~np.isnan(apart)
        total += np.where(there, apart, 0.0)
        valid += there
    return np.where(valid > 0, total / np.maximum(valid, 1), 1.0)


def knn(df: DataFrame, column: str, features: Sequence[str], k: int = 5, seed: int = 0) -> DataFrame:
    """Mean of the k nearest rows that have ``column`` by range-scaled distance, weighted by 1 / (distance + 1e-5).

    The distance is taken over the features that both rows have (1 if there is
    none), scaled by each feature's range over all rows. Every donor is
    compared: blocks of donors meet blocks of distinct receivers, and the k
    best of the blocks are merged. Equal distances go by a seeded hash of the row.
    """
    spark = df.sparkSession
    names = [f"__f{i}" for i in range(len(features))]
    cells = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) + F.lit(0.0) for f in features]
    has = F.col(column).isNotNull()
    one = df.select(F.col(column), *[c.alias(n) for c, n in zip(cells, names)]).agg(F.count(column), *[x for n in names for x in (F.min(n), F.max(n))]).collect()[0]
    if not one[0]:
        raise StatError("S0202", "no rows with the column")
    span = np.array([1.0 if low is None or high - low < 1e-9 else high - low for low, high in zip(one[1::2], one[2::2])])
    given = [c.alias(n) for c, n in zip(cells, names)]
    asked = df.filter(~has).select(*given).distinct()
    y = F.col(column).cast("double")
    donors = df.filter(has).select(y.alias("__y"), F.xxhash64(F.lit(seed), y, *cells).alias("__h"), *given).repartition(spark.sparkContext.defaultParallelism)
    pairs = _blocks(donors, DONOR_ROWS, "donors").crossJoin(_blocks(asked, RECEIVER_ROWS, "receivers"))

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                y, h, *x = pickle.loads(a.as_py())
                raw = np.column_stack(pickle.loads(b.as_py())).astype(float)
                order = np.lexsort((y, h))
                y, h, x = y[order], h[order], np.column_stack(x).astype(float)[order] / span
                step = max(1, CELLS // len(x))
                for at in range(0, len(raw), step):
                    part = raw[at : at + step]
                    d = _gower(part / span, x)
                    edge = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(d), np.inf)
                    row, donor = np.nonzero(d <= edge[:, None])
                    order = np.lexsort((donor, d[row, donor], row))
                    row, donor = row[order], donor[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(part)))[row] < k
                    row, donor = row[keep], donor[keep]
                    out = [pa.array(part[row, j], from_pandas=True) for j in range(part.shape[1])]
                    yield pa.RecordBatch.from_arrays([*out, pa.array(d[row, donor]), pa.array(h[donor]), pa.array(y[donor])], names=[*names, "__d", "__h", "__y"])

    near = pairs.mapInArrow(run, ", ".join([*[f"{n} double" for n in names], "__d double", "__h long", "__y double"]))
    place = F.row_number().over(Window.partitionBy(*names).orderBy("__d", "__h", "__y"))
    weight = 1 / (F.col("__d") + 1e-5)
    means = near.withColumn("__k", place).filter(F.col("__k") <= k).groupBy(*names).agg((F.sum(weight * F.col("__y")) / F.sum(weight)).alias("__new"))
    means = means.select(*[F.col(n).alias(f"{n}_") for n in names], "__new")
    missing = df.filter(~has).withColumns(dict(zip(names, cells)))
    same = reduce(and_, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names])
    filled = missing.join(means, same, "left").withColumn(column, F.col("__new")).select(*df.columns)
    return df.filter(has).withColumn(column, F.col(column).cast("double")).unionByName(filled)


def _fit(df: DataFrame, column: str, features: Sequence[str], by: Sequence[str] = ()) -> np.ndarray:
    """Ridge-stabilised least squares on complete rows."""
    rows = df.select(column, *features).dropna()
    p = len(features) + 1
    out = fold(rows, [column, *features], lambda m: np.append((np.column_stack([np.ones(len(m)), m[:, 1:]]).T @ np.column_stack([np.ones(len(m)), m[:, 1:], m[:, 0]])).ravel(), (m[:, 0] ** 2).sum()))
    cross = out[:-1].reshape(p, p + 1)
    gram = cross[:, :p] + 1e-8 * np.eye(p) * max(np.trace(cross[:, :p]) / p, 1e-12)
    beta = np.linalg.solve(gram, cross[:, p])
    n = cross[0, 0]
    s2 = max(out[-1] - 2 * beta @ cross[:, p] + beta @ cross[:, :p] @ beta, 0) / max(n - p, 1)
    return np.append(beta, s2)


def _linear(beta: np.ndarray, features: Sequence[str]) -> Column:
    return sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta[1:], features)), F.lit(float(beta[0])))


def pmm(df: DataFrame, column: str, features: Sequence[str], donors: int = 5, seed: int = 0, key: Sequence[str] = ()) -> DataFrame:
    """Predictive mean matching: one of the ``donors`` complete rows nearest in prediction, chosen by a hash of seed and row.

    All complete rows are donors. Donors and receivers are dealt into ranges of
    the prediction (equal ones by a hash); a range searches its own donors and
    the outermost ones of every other range, which hold all nearest ones.
    Rows without a prediction come after the largest.
    """
    full = df.select(F.col(column).cast("double").alias("__v"), *features).dropna()
    if not full.limit(1).count():
        raise StatError("S0202", "no complete rows")
    beta = _fit(df, column, features)
    guess = F.coalesce(_linear(beta[:-1], features), F.lit(float("nan"))) + F.lit(0.0)
    marked = df.withColumns({"__p": guess, "__h": F.xxhash64(F.lit(seed), *(key or df.columns))})
    # repeated donors are counted, so that they don't pile up in one range
    give = full.groupBy(guess.alias("__p"), "__v").agg(F.count(F.lit(1)).alias("__n")).select("__p", F.xxhash64(F.lit(seed), "__v").alias("__h"), "__v", "__n")
    take = marked.filter(F.col(column).isNull()).select("__p", "__h").distinct().select("__p", "__h", F.lit(None).cast("double").alias("__v"), F.lit(0).cast("long").alias("__n"))
    dealt = cut(give.unionByName(take).repartitionByRange("__p", "__h").withColumn("__part", F.spark_partition_id()))
    held = dealt.filter("__n > 0")
    ends = [held.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*by))).filter(F.col("__k") <= donors).drop("__k") for by in (["__p", "__h", "__v"], [F.desc("__p"), F.desc("__h"), F.desc("__v")])]
    border = ends[0].unionByName(ends[1]).distinct().toPandas()

    def run(own: pd.DataFrame) -> pd.DataFrame:
        asked = own[own["__n"] == 0]
        rows = pd.concat([own, border[border["__part"] != own["__part"].iloc[0]]]).sort_values(["__p", "__h", "__v"], na_position="last", kind="stable")
        p, h, v = rows["__p"].to_numpy(), rows["__h"].to_numpy(), rows["__v"].to_numpy()
        n = np.minimum(rows["__n"].to_numpy(), donors)
        place = np.cumsum(n)[n == 0]
        at, values = np.repeat(p, n), np.repeat(v, n)
        p, h = p[n == 0], h[n == 0]
        cand = place[:, None] + np.arange(-donors, donors)[None, :]
        out = (cand < 0) | (cand >= len(at))
        cand = np.clip(cand, 0, len(at) - 1)
        apart = np.where(out, np.inf, np.nan_to_num(np.abs(at[cand] - p[:, None]), nan=0.0))
        near = np.take_along_axis(cand, np.argsort(apart, axis=1, kind="stable"), axis=1)
        some = np.minimum((~out).sum(axis=1), donors)
        return pd.DataFrame({"__p_": p, "__h_": h, "__new": values[near[np.arange(len(p)), h % some]]}, index=range(len(asked)))

    found = dealt.groupBy("__part").applyInPandas(run, "__p_ double, __h_ long, __new double")
    same = F.col(column).isNull() & (F.col("__p") == F.col("__p_")) & (F.col("__h") == F.col("__h_"))
    return marked.join(found, same, "left").withColumn(column, F.coalesce(F.col(column).cast("double"), F.col("__new"))).select(*df.columns)


def mice(df: DataFrame, columns: Sequence[str], m: int = 5, iterations: int = 10, method: str | Callable = "pmm", seed: int = 0, key: Sequence[str] = ()) -> list[DataFrame]:
    """Chained equations: each column in turn is modelled on the others and its missing cells are drawn anew.

    ``method`` is pmm, norm, mean, knn or a function (df, column, features,
    seed) -> df. Chains start from column means with seeds of their own.
    """
    missing = [c for c in columns if df.filter(F.col(c).isNull()).limit(1).count()]
    flags = df.select("*", *[F.col(c).isNull().alias(f"__na_{c}") for c in missing])
    means = flags.agg(*[F.avg(c).alias(c) for c in missing]).collect()[0].asDict() if missing else {}
    out = []
    for chain in range(m):
        at = flags.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in missing})
        for it in range(iterations if method != "mean" else 0):
            for c in missing:
                others = [x for x in columns if x != c]
                hole = at.withColumn(c, F.when(~F.col(f"__na_{c}"), F.col(c)))
                s = seed + chain * 7919 + it * 104729
                if callable(method):
                    new = method(hole, c, others, s)
                elif method == "pmm":
                    new = pmm(hole, c, others, seed=s, key=key or df.columns)
                elif method == "knn":
                    new = knn(hole, c, others, seed=s)
                elif method == "norm":
                    beta = _fit(hole, c, others)
                    u = (F.shiftrightunsigned(F.xxhash64(F.lit(s), *(key or df.columns)), 11).cast("double") + 0.5) / F.lit(float(2**53))
                    noise = D.normal().column("quantile", u)
                    new = hole.withColumn(c, F.coalesce(F.col(c), _linear(beta[:-1], others) + F.lit(float(np.sqrt(beta[-1]))) * noise))
                else:
                    raise StatError("S0202", f"no method {method}")
                at = cut(new)
        out.append(at.drop(*[f"__na_{c}" for c in missing]))
    return out


def pool(estimates: Sequence[float], std_errors: Sequence[float], df_complete: float | None = None) -> dict:
    """Rubin's rules with Barnard-Rubin degrees of freedom."""
    q, u = np.asarray(estimates, float), np.asarray(std_errors, float) ** 2
    m = len(q)
    if m < 2:
        raise StatError("S0202", "two imputations or more are needed")
    mean, within, between = q.mean(), u.mean(), q.var(ddof=1)
    total = within + (1 + 1 / m) * between
    lam = (1 + 1 / m) * between / total if total > 0 else 0.0
    old = (m - 1) / lam**2 if lam > 0 else np.inf
    dof = old if df_complete is None else 1 / (1 / old + 1 / ((df_complete + 1) / (df_complete + 3) * df_complete * (1 - lam)))
    dof = float(min(dof, 1e9))
    riv = (1 + 1 / m) * between / within if within > 0 else float("inf")
    se = float(np.sqrt(total))
    t = D.student_t(dof)
    half = float(t.quantile(0.975)) * se
    return dict(estimate=float(mean), std_error=se, df=dof, riv=float(riv), fmi=float((riv + 2 / (dof + 3)) / (riv + 1)), statistic=float(mean / se), p_value=float(2 * t.cdf(-abs(mean / se))), conf_low=float(mean - half), conf_high=float(mean + half))


def pool_with(frames: Sequence[DataFrame], fit: Callable) -> dict[str, dict]:
    """Fit a model on each imputed table and pool its terms."""
    tables = [fit(f) for f in frames]
    terms = [r["term"] for r in tables[0].tidy()]
    rows = [t.tidy() for t in tables]
    return {term: pool([r[i]["estimate"] for r in rows], [r[i]["std_error"] for r in rows], tables[0].df_resid) for i, term in enumerate(terms)}


def vif(df: DataFrame, columns: Sequence[str]) -> list[dict]:
    """Variance inflation factors from complete rows."""
    from .tests import sample_cov

    cov = sample_cov(df, list(columns))
    sd = np.sqrt(np.diag(cov))
    values = np.diag(np.linalg.inv(cov / np.outer(sd, sd)))
    return [dict(column=c, vif=float(v), severity="high" if v > 10 else "moderate" if v > 5 else "low") for c, v in zip(columns, values)]
