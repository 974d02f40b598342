import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.errors import StatError
from tidemill.functions import matrices as M
from tidemill.models import sem, summaries


def test_matrices(spark):
    a, b = np.array([[2.0, 1.0], [1.0, 3.0]]), np.array([[1.0, 0.5], [0.0, 2.0]])
    np.testing.assert_allclose(M.solve(a, [3, 5]), [0.8, 1.4])
    q, r = M.qr(a)
    np.testing.assert_allclose(q @ r, a)
    u, s, v = M.svd(a)
    np.testing.assert_allclose(u * s @ v.T, a)
    assert M.eigen(a)[0][0] > M.eigen(a)[0][1]
    with pytest.raises(StatError):
        M.cholesky([[1, 2], [2, 1]])
    entries = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(2) for j in range(2)], "i int, j int, v double")
    got = {(r.i, r.j): r.v for r in M.multiply(entries(a), entries(b)).collect()}
    assert got == pytest.approx({(i, j): (a @ b)[i, j] for i in range(2) for j in range(2)})
    assert {r.i: r.v for r in M.reduce_axis(entries(a), "row").collect()} == {0: 3.0, 1: 4.0}
    one = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "m array<array<double>>")
    assert list(one.select(M.row_sums(F.col("m")), M.col_means(F.col("m")), M.transposed(F.col("m"))).collect()[0]) == [[3.0, 7.0], [2.0, 3.0], [[1.0, 3.0], [2.0, 4.0]]]
    assert (M.philox(3, 5) == M.philox(3, 9)[:5]).all()


def test_factor_model(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    f = rng.normal(size=2000)
    x = np.column_stack([f + 0.5 * rng.normal(size=2000), 0.8 * f + 0.6 * rng.normal(size=2000), 1.2 * f + 0.4 * rng.normal(size=2000), 0.5 * f + rng.normal(size=2000)])
    df = spark.createDataFrame(x.tolist(), ["a", "b", "c", "d"])
    fit = sem.sem("f =~ a + b + c + d", df)
    got = {r["term"]: r["estimate"] for r in fit["table"]}
    assert got["f=~b"] == pytest.approx(0.8, abs=0.06) and got["f=~c"] == pytest.approx(1.2, abs=0.08)
    assert fit["df"] == 2 and fit["cfi"] > 0.98 and fit["rmsea"] < 0.06
    with pytest.raises(StatError):
        sem.decompose_spec("nonsense")


def test_summaries(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 10)] + [(100.0,)], "v double")
    r = summaries.five_numbers(df, "v").collect()[0]
    assert (r.low, r.median, r.high, r.outliers) == (1.0, 5.5, 9.0, 1)
    assert summaries.histogram(df, "v", 3).agg(F.sum("n")).collect()[0][0] == 10
    assert summaries.simple_linear_fit(df.withColumn("w", F.col("v") * 2 + 1), "v", "w").collect()[0].slope == pytest.approx(2)
    with pytest.raises(ValueError):
        summaries.vega_lite(df, "point", "v", "v", most=3)


def test_two_abilities(spark):
    from tidemill.models import irt, irt_multi

    rng = np.random.Generator(np.random.PCG64(3))
    theta = rng.normal(size=(1500, 2))
    slopes = np.array([[1.5, 0], [1.2, 0], [1.4, 0], [0, 1.5], [0, 1.3], [0, 1.2]])
    y = (rng.random((1500, 6)) < 1 / (1 + np.exp(-(theta @ slopes.T)))).astype(int)
    items = [f"i{k}" for k in range(6)]
    df = spark.createDataFrame(np.column_stack([y, np.arange(1500)]).tolist(), [*items, "id"])
    fit = irt_multi.fit_compensatory(df, items, {f"i{k}": [k // 3] for k in range(6)}, 2, rounds=40)
    assert np.abs(fit["slopes"] - slopes).max() < 0.6
    got = np.array([r.theta for r in irt_multi.score(df, fit).orderBy("id").collect()])
    assert np.corrcoef(got[:, 0], theta[:, 0])[0, 1] > 0.6
    bi = irt_multi.fit_bifactor(df, items, {f"i{k}": k // 3 for k in range(6)}, rounds=6)
    assert 0 < bi["ecv"] < 1
    one = irt.fit_dichotomous(df.select(items[:3]), items[:3], rounds=40)
    assert irt_multi.bivariate_fit(df.select(items[:3]), one)["rms"] < 2
    np.testing.assert_allclose(irt_multi.nominal_probabilities(np.zeros(1), [0, 1], [0, 0]), [[0.5, 0.5]])


def test_decomposition_adds_up_to_the_two_way_estimate(spark):
    from tidemill.models import causal, linear

    rng = np.random.Generator(np.random.PCG64(5))
    rows = []
    for u in range(40):
        g = [None, 3, 6][u % 3]
        for t in range(9):
            d = int(g is not None and t >= g)
            rows.append((u, t, g, d, float(u % 5 + 0.3 * t + 2.0 * d + rng.normal())))
    df = spark.createDataFrame(rows, "u int, t int, g int, d int, y double")
    parts = causal.bacon_decompose(df, "y", "u", "t", "g")
    assert sum(p["weight"] for p in parts) == pytest.approx(1) and len(parts) == 4
    assert sum(p["weight"] * p["estimate"] for p in parts) == pytest.approx(linear.feols("y ~ d | u + t", df).coef[0], rel=1e-6)
