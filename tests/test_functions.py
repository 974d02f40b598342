import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.errors import StatError
from tidemill.functions import distributions as D
from tidemill.functions import scalar as S
from tidemill.functions import vectors as V


def one(spark, c):
    return spark.range(1).select(c.alias("v")).collect()[0].v


@pytest.mark.parametrize(
    "make, expected",
    [
        (lambda: S.log(F.lit(0.0)), -math.inf),
        (lambda: S.log(F.lit(-1.0)), None),
        (lambda: S.sqrt(F.lit(-1.0)), None),
        (lambda: S.divide(F.lit(1), F.lit(0)), math.inf),
        (lambda: S.divide(F.lit(0), F.lit(0)), None),
        (lambda: S.divide(F.lit(7), F.lit(2)), 3.5),
        (lambda: S.round_half_away(F.lit(-2.5)), -3.0),
        (lambda: S.clamp(F.lit(5), 1, 3), 3),
        (lambda: S.str_trim(F.lit("  x \t")), "x"),
        (lambda: S.str_pad(F.lit("abcdef"), 3), "abcdef"),
        (lambda: S.str_pad(F.lit("a"), 3, "0"), "00a"),
        (lambda: S.str_split(F.lit("a.b..c."), "."), ["a", "b", "", "c", ""]),
        (lambda: S.to_int(F.lit(" 42 ")), 42),
        (lambda: S.to_int(F.lit("x"), strict=False), None),
        (lambda: S.to_bool(F.lit("1")), True),
        (lambda: S.format_string("{:.2} {}", F.lit(1.005), F.lit("z")), "1.01 z"),
        (lambda: S.if_else(F.lit(None).cast("boolean"), 1, 2), None),
        (lambda: V.vec_dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), 11.0),
        (lambda: V.vec_sum(F.array(F.lit(1.0), F.lit(None))), None),
        (lambda: V.vec_sort(F.array(F.lit(2), F.lit(1)), True), [2, 1]),
    ],
)
def test_scalar(spark, make, expected):
    assert one(spark, make()) == expected


KNOWN = [
    (D.normal(), 1.96, 0.9750021048517795),
    (D.student_t(5), 2.015048372669157, 0.95),
    (D.chisq(3), 7.814727903251179, 0.95),
    (D.fisher_f(3, 10), 3.708264819046839, 0.95),
    (D.beta(2, 3), 0.4, 0.5248),
    (D.gamma(2, 1), 1.6783469900166605, 0.5),
    (D.exponential(2), 0.34657359027997264, 0.5),
    (D.uniform(2, 4), 3.0, 0.5),
    (D.binomial(10, 0.3), 3, 0.6496107184),
    (D.poisson(4), 2, 0.23810330555354436),
]


@pytest.mark.parametrize("dist, x, p", KNOWN, ids=[d.name for d, _, _ in KNOWN])
def test_distribution_functions(dist, x, p):
    assert float(dist.cdf(x)) == pytest.approx(p, abs=1e-9)
    q = float(dist.quantile(p * (1 - 1e-12)))
    assert q == pytest.approx(x, rel=1e-7)


@pytest.mark.parametrize("dist", [D.normal(1, 2), D.gamma(3, 2), D.student_t(4), D.fisher_f(4, 9), D.beta(2, 5)], ids=lambda d: d.name)
def test_densities_integrate_to_the_distribution_function(dist):
    a, b = float(dist.quantile(0.2)), float(dist.quantile(0.7))
    x = np.linspace(a, b, 4001)
    y = dist.density(x)
    area = ((y[1:] + y[:-1]) / 2 * np.diff(x)).sum()
    assert area == pytest.approx(0.5, abs=1e-5)


def test_columns_and_draws(spark):
    d = spark.createDataFrame([(0.0,), (None,)], "x double").select(D.normal().column("cdf", "x").alias("p"))
    assert [r.p for r in d.collect()] == [0.5, None]
    draws = [r.value for r in D.gamma(2, 1).sample(spark, 2000, 5).collect()]
    again = [r.value for r in D.gamma(2, 1).sample(spark, 2000, 5).repartition(7).orderBy("id").collect()]
    assert sorted(draws) == sorted(again)
    assert np.mean(draws) == pytest.approx(2, abs=0.15)
    with pytest.raises(StatError):
        D.normal(0, -1)
