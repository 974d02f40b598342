"""Statistics behind plots, as data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def simple_linear_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"))


def five_numbers(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Whisker ends within 1.5 interquartile ranges, quartiles and median, and the number of values beyond."""
    q = df.groupBy(*by).agg(*[F.percentile(value, F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    both = df.join(q, list(by)) if by else df.crossJoin(F.broadcast(q))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    out = both.groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.count(F.when(~inside, 1)).alias("outliers"))
    return out.select(*by, "low", "q1", "median", "q3", "high", "outliers")


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """bin, its lower end and its count, over the range of the values."""
    low, high = df.agg(F.min(value), F.max(value)).collect()[0]
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, n long")
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.lit(float(low)) + F.col("bin") * F.lit(float(width))).alias("low"), "n")


def vega_lite(df: DataFrame, mark: str, x: str, y: str, color: str | None = None, most: int = 5000) -> dict:
    """A chart of an aggregated table as Vega-Lite; a table over ``most`` rows is refused rather than cut."""
    rows = [r.asDict() for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: aggregate first")
    encode = {"x": {"field": x}, "y": {"field": y}} | ({"color": {"field": color}} if color else {})
    return {"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "data": {"values": rows}, "mark": mark, "encoding": encode}
