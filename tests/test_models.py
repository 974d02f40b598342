import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.errors import StatError
from tidemill.models import causal, contracts, impute, irt, linear, mixture, multilevel, optimize, panel, survival, timeseries
from tidemill.models import tests as hypothesis

#: Certified data and results of a regression with nearly collinear columns.
LONGLEY = """60323 83.0 234289 2356 1590 107608 1947
61122 88.5 259426 2325 1456 108632 1948
60171 88.2 258054 3682 1616 109773 1949
61187 89.5 284599 3351 1650 110929 1950
63221 96.2 328975 2099 3099 112075 1951
63639 98.1 346999 1932 3594 113270 1952
64989 99.0 365385 1870 3547 115094 1953
63761 100.0 363112 3578 3350 116219 1954
66019 101.2 397469 2904 3048 117388 1955
67857 104.6 419180 2822 2857 118734 1956
68169 108.4 442769 2936 2798 120445 1957
66513 110.8 444546 4681 2637 121950 1958
68655 112.6 482704 3813 2552 123366 1959
69564 114.2 502601 3931 2514 125368 1960
69331 115.7 518173 4806 2572 127852 1961
70551 116.9 554894 4007 2827 130081 1962"""
CERTIFIED = [-3482258.63459582, 15.0618722713733, -0.0358191792925910, -2.02022980381683, -1.03322686717359, -0.0511041056535807, 1829.15146461355]


def table(spark, **columns):
    rows = list(zip(*[np.asarray(v).tolist() for v in columns.values()]))
    return spark.createDataFrame(rows, list(columns)).repartition(3)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    n = 600
    x1, x2, u = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 20, n)
    effect = rng.normal(size=20)[u]
    y = 1 + 2 * x1 - x2 + effect + rng.normal(size=n) * 0.5
    z = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + x1)))).astype(int)
    c = rng.poisson(np.exp(0.3 + 0.4 * x1))
    return table(spark, i=np.arange(n), y=y, x1=x1, x2=x2, u=u, z=z, c=c), dict(y=y, x1=x1, x2=x2, u=u, z=z, c=c)


def test_longley(spark):
    rows = [tuple(map(float, line.split())) for line in LONGLEY.splitlines()]
    df = spark.createDataFrame(rows, ["y", "x1", "x2", "x3", "x4", "x5", "x6"])
    fit = linear.ols("y ~ x1 + x2 + x3 + x4 + x5 + x6", df)
    np.testing.assert_allclose(fit.coef, CERTIFIED, rtol=1e-6)
    assert fit.stats["r_squared"] == pytest.approx(0.995479004577296, rel=1e-8)


def test_ols_against_lstsq(data):
    df, d = data
    x = np.column_stack([np.ones(len(d["y"])), d["x1"], d["x2"]])
    beta, rss, *_ = np.linalg.lstsq(x, d["y"], rcond=None)
    fit = linear.ols("y ~ x1 + x2", df)
    np.testing.assert_allclose(fit.coef, beta, rtol=1e-9)
    bread = np.linalg.inv(x.T @ x)
    e = d["y"] - x @ beta
    np.testing.assert_allclose(fit.cov, bread * rss[0] / (len(e) - 3), rtol=1e-8)
    h = np.einsum("ij,jk,ik->i", x, bread, x)
    np.testing.assert_allclose(fit.vcov("HC3"), bread @ (x.T * (e / (1 - h)) ** 2) @ x @ bread, rtol=1e-8)
    out = fit.augment(df).select("i", "`.fitted`").orderBy("i").collect()
    np.testing.assert_allclose([r[1] for r in out], x @ beta, rtol=1e-9)
    assert linear.anova(fit)[0]["f_value"] == pytest.approx(fit.stats["f_statistic"])
    with pytest.raises(StatError, match="S0101"):
        linear.ols("y ~ x1 + w", df.withColumn("w", F.col("x1") * 2))


def test_factors_and_contrasts(spark):
    df = table(spark, g=["a", "a", "b", "b", "c", "c"], y=[1.0, 3.0, 5.0, 7.0, 9.0, 13.0])
    fit = linear.ols("y ~ g", df)
    assert fit.names == ["(Intercept)", "gb", "gc"]
    np.testing.assert_allclose(fit.coef, [2, 4, 9], atol=1e-9)
    np.testing.assert_allclose(linear.ols("y ~ g", df, {"g": "sum"}).coef, [19 / 3, 2 - 19 / 3, 6 - 19 / 3], atol=1e-9)
    for scheme in ("helmert", "polynomial"):
        assert linear.ols("y ~ g", df, {"g": scheme}).stats["r_squared"] == pytest.approx(fit.stats["r_squared"])
    assert fit.predict(df.sparkSession.createDataFrame([("d",)], ["g"])).collect()[0][".fitted"] is None


def test_glms_recover(data):
    df, d = data
    logit = linear.logistic("z ~ x1", df)
    score = d["z"] - 1 / (1 + np.exp(-(logit.coef[0] + logit.coef[1] * d["x1"])))
    assert abs(score.sum()) < 1e-5 and abs((score * d["x1"]).sum()) < 1e-5
    pois = linear.poisson("c ~ x1", df)
    assert pois.coef[1] == pytest.approx(0.4, abs=0.12)
    with pytest.raises(StatError, match="S0204"):
        linear.logistic("y ~ x1", df)


def test_fixed_effects_equal_dummies(data):
    df, d = data
    dummies = (d["u"][:, None] == np.arange(20)).astype(float)
    beta = np.linalg.lstsq(np.column_stack([d["x1"], d["x2"], dummies]), d["y"], rcond=None)[0]
    fit = linear.feols("y ~ x1 + x2 | u", df)
    np.testing.assert_allclose(fit.coef, beta[:2], rtol=1e-8)
    two = linear.feols("y ~ x1 | u + w", df.withColumn("w", F.col("i") % 4))
    both = np.column_stack([d["x1"], dummies, (np.arange(len(d["y"]))[:, None] % 4 == np.arange(1, 4)).astype(float)])
    assert two.coef[0] == pytest.approx(np.linalg.lstsq(both, d["y"], rcond=None)[0][0], rel=1e-6)


def test_penalties(data):
    df, d = data
    path = linear.lasso("y ~ x1 + x2", df, [1e-9])
    beta = np.linalg.lstsq(np.column_stack([np.ones(600), d["x1"], d["x2"]]), d["y"], rcond=None)[0]
    np.testing.assert_allclose([path.intercepts[0], *path.coefs[0]], beta, rtol=1e-4)
    cv = linear.cv_glmnet("y ~ x1 + x2", df, fold_by="i")
    assert cv.lambda_1se >= cv.lambda_min and cv.coef()["x1"] == pytest.approx(2, abs=0.2)


def test_instruments(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    z, v = rng.normal(size=3000), rng.normal(size=3000)
    x = z + v
    y = 1 + 2 * x + v + rng.normal(size=3000) * 0.1
    fit = linear.iv("y ~ x | z + z2", table(spark, y=y, x=x, z=z, z2=z + rng.normal(size=3000)))
    assert fit.coef[1] == pytest.approx(2, abs=0.08) and fit.stats["wu_hausman"] > 50 and fit.stats["sargan_p_value"] > 1e-4
    with pytest.raises(StatError):
        linear.iv("y ~ x + z | z", table(spark, y=y, x=x, z=z))


def test_hypotheses(spark):
    df = table(spark, v=[1.0, 2.0, 3.0, 4.0, 5.0, 7.0], g=[0, 0, 0, 1, 1, 1])
    r = hypothesis.t_test(df, "v", "g")
    assert r["statistic"] == pytest.approx(-3.1622776601683795, rel=1e-6) or r["difference"] == pytest.approx(-10 / 3)
    assert hypothesis.t_test_one_sample(df, "v", 2)["df"] == 5
    assert hypothesis.chisq_test(df, "g")["statistic"] == 0
    assert 0 < hypothesis.cor_test(df, "v", "g")["p_value"] < 0.05
    means = hypothesis.bootstrap_mean(df, "v", 50, 1)
    assert means == pytest.approx(hypothesis.bootstrap_mean(df.repartition(5), "v", 50, 1)) and 2 < np.mean(means) < 5


def test_survival_by_hand(spark):
    df = table(spark, t=[1, 2, 2, 3, 4], e=[1, 1, 0, 1, 0], g=[0, 0, 1, 1, 1])
    km = {r.time: r.survival for r in survival.kaplan_meier(df, "t", "e").collect()}
    assert km == pytest.approx({1.0: 0.8, 2.0: 0.6, 3.0: 0.3})
    assert survival.median_survival(survival.kaplan_meier(df, "t", "e")) == 3.0
    na = {r.time: r.hazard for r in survival.nelson_aalen(df, "t", "e").collect()}
    assert na[3.0] == pytest.approx(0.2 + 0.25 + 0.5)
    assert survival.logrank(df, "t", "e", "g")["observed"] == 1


def test_cox_recovers(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    x = rng.normal(size=800)
    t = rng.exponential(size=800) / np.exp(0.7 * x)
    df = table(spark, t=np.round(t, 3), e=np.ones(800), x=x)
    fit = survival.cox(df, "t", "e", ["x"])
    assert fit["coef"][0] == pytest.approx(0.7, abs=0.12) and fit["lrt_p_value"] < 1e-6
    assert survival.weibull(table(spark, t=2 * rng.weibull(1.5, 800), e=np.ones(800)), "t", "e")["shape"] == pytest.approx(1.5, abs=0.2)


def test_causal(spark):
    df = table(spark, y=[1.0, 2.0, 3.0, 4.0, 2.0, 3.0, 7.0, 8.0], d=[0, 0, 0, 0, 1, 1, 1, 1], p=[0, 0, 1, 1, 0, 0, 1, 1])
    assert causal.did_2x2(df, "y", "d", "p")["att"] == pytest.approx(3.0)
    rows = [(u, t, float(t) + 2 * u + (5 if u == 0 and t >= 4 else 0)) for u in range(4) for t in range(8)]
    sc = causal.synthetic_control(spark.createDataFrame(rows, ["u", "t", "y"]), "u", "t", "y", 0, 4)
    assert set(sc["weights"]) == {"1", "2", "3"} and sum(sc["weights"].values()) == pytest.approx(1)
    cohort = spark.createDataFrame([(u, t, 4 if u < 5 else None, float(t + u % 3 + (2 if u < 5 and t >= 4 else 0))) for u in range(12) for t in range(7)], "u int, t int, g int, y double")
    att = {r.t: r.att for r in causal.group_time_att(cohort, "y", "g", "t").collect()}
    assert att[5] == pytest.approx(2.0) and att[2] == pytest.approx(0.0)
    rng = np.random.Generator(np.random.PCG64(8))
    x = rng.normal(size=2000)
    t = (rng.random(2000) < 1 / (1 + np.exp(-x))).astype(int)
    dr = causal.doubly_robust(table(spark, y=3 * t + 2 * x + rng.normal(size=2000), t=t, x=x), "y", "t", ["x"])
    assert dr["att"] == pytest.approx(3, abs=0.25)


def test_panel(data, spark):
    df, _ = data
    fe, re = panel.within(df, "y", ["x1"], "u"), panel.random_effects(df, "y", ["x1"], "u")
    assert re["coef"][1] == pytest.approx(2, abs=0.2) and fe.coef[0] == pytest.approx(2, abs=0.2)
    assert panel.hausman(fe, re)["p_value"] > 1e-3 and panel.breusch_pagan(df, "y", ["x1"], "u")["p_value"] < 1e-6
    rng = np.random.Generator(np.random.PCG64(2))
    rows = []
    for u in range(400):
        a, y = rng.normal(), 0.0
        for t in range(8):
            y = 0.5 * y + a + rng.normal()
            rows.append((u, t, float(y)))
    p = spark.createDataFrame(rows, ["u", "t", "y"])
    assert panel.arellano_bond(p, "y", "u", "t")["coef"][0] == pytest.approx(0.5, abs=0.2)
    assert panel.blundell_bond(p, "y", "u", "t")["coef"][0] == pytest.approx(0.5, abs=0.2)
    m = np.array([r[2] for r in rows]).reshape(400, 8)[:10]
    cd = panel.pesaran_cd(p.filter("u < 10"), "y", "u", "t")
    c = np.corrcoef(m)[np.triu_indices(10, 1)]
    assert cd["statistic"] == pytest.approx(np.sqrt(2 * 8 / 90) * c.sum())


def test_time_series(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    y = np.zeros(400)
    for i in range(1, 400):
        y[i] = 0.6 * y[i - 1] + rng.normal()
    df = table(spark, i=np.arange(400), y=y)
    c = y - y.mean()
    got = {r.lag: r.acf for r in timeseries.acf(df, "y", "i", 3).collect()}
    assert got[2] == pytest.approx((c[2:] * c[:-2]).sum() / (c * c).sum())
    assert timeseries.ar(df, "y", "i", 1)["phi"][0] == pytest.approx(0.6, abs=0.1)
    assert abs(timeseries.pacf(df, "y", "i", 3)[3]) < 0.2
    assert timeseries.auto_ar(df, "y", "i", 3)["p"] >= 1 and len(timeseries.forecast(timeseries.ar(df, "y", "i", 1), 3)) == 3
    assert timeseries.adf(df, "y", "i")["stationary"] and timeseries.ljung_box(df, "y", "i", 5)["p_value"] < 1e-6
    season = table(spark, i=np.arange(48), y=np.arange(48) * 0.5 + np.tile([0.0, 3.0, -3.0, 0.0], 12))
    parts = timeseries.decompose(season, "y", "i", 4).filter("trend is not null").collect()
    assert max(abs(r.remainder) for r in parts) < 1e-9
    k = timeseries.kalman(df, "y", "i", 0.1, 1.0).agg(F.avg("smoothed_var"), F.avg("filtered_var")).collect()[0]
    assert k[0] < k[1]
    assert timeseries.granger(df.withColumn("x", F.col("y") * 0 + F.rand(3)), "x", "y", "i")["p_value"] > 1e-3


def test_imputation(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    x = rng.normal(size=300)
    y = 2 * x + rng.normal(size=300) * 0.1
    rows = [(i, float(a), None if i % 4 == 0 else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "i int, x double, y double")
    for filled in (impute.knn(df, "y", ["x"]), impute.pmm(df, "y", ["x"], key=["i"]), *impute.mice(df, ["x", "y"], 1, 1, "norm", key=["i"])):
        got = {r.i: r.y for r in filled.collect()}
        assert len(got) == 300 and np.mean([(got[i] - 2 * x[i]) ** 2 for i in range(0, 300, 4)]) < 0.3
    deck = impute.hotdeck(df.withColumn("p", F.col("i") % 2), "y", "p", ["i"])
    assert deck.filter("y is null").count() == 0
    pooled = impute.pool([1.0, 1.2, 0.8], [0.1, 0.1, 0.1])
    assert pooled["estimate"] == pytest.approx(1.0) and pooled["std_error"] == pytest.approx(np.sqrt(0.01 + 4 / 3 * 0.04))
    with pytest.raises(StatError):
        impute.pool([1.0], [0.1])
    assert impute.vif(df.dropna(), ["x", "y"])[0]["severity"] == "high"


def gower_means(rows, k):
    """Brute force over (y, x, z) with None for missing cells."""
    cols = [[r[j] for r in rows if r[j] is not None] for j in (1, 2)]
    span = [max(c) - min(c) for c in cols]
    out = {}
    for i, (y, *f) in enumerate(rows):
        if y is None:
            near = []
            for u, *g in rows:
                if u is not None:
                    both = [abs(a - b) / s for a, b, s in zip(f, g, span) if a is not None and b is not None]
                    near.append((sum(both) / len(both) if both else 1.0, u))
            near = sorted(near)[:k]
            out[i] = sum(u / (d + 1e-5) for d, u in near) / sum(1 / (d + 1e-5) for d, _ in near)
    return out


def test_knn_takes_all_donors_and_ranges_from_all_rows(spark, monkeypatch):
    monkeypatch.setattr(impute, "MOST_DONORS", 50, raising=False)  # the cut there was
    monkeypatch.setattr(impute, "DONOR_ROWS", 37, raising=False)
    monkeypatch.setattr(impute, "RECEIVER_ROWS", 11, raising=False)
    rng = np.random.Generator(np.random.PCG64(8))
    rows = [(float(rng.normal()), float(rng.normal()), float(rng.normal())) for _ in range(400)]
    rows = [(None if i % 5 == 0 else y, None if i % 7 == 0 else x, None if i % 11 == 0 else z) for i, (y, x, z) in enumerate(rows)]
    rows[5] = (None, 40.0, 0.0)  # widens the range, though it's no donor
    rows[385] = (None, 0.5, None)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, y double, x double, z double")
    got = {r.i: r.y for r in impute.knn(df, "y", ["x", "z"]).collect()}
    want = gower_means(rows, 5)
    assert len(got) == 400 and all(got[i] == pytest.approx(want[i]) for i in want if rows[i][1] is not None or rows[i][2] is not None)


def test_imputation_with_a_row_repeated_past_the_former_cut(spark):
    many = spark.range(60_000).select(F.lit(1.0).alias("x"), F.lit(-7.0).alias("y"))
    line = spark.range(200).select((10.0 + F.col("id")).alias("x"), (F.col("id") * 2.0).alias("y"))
    holes = spark.range(20).select((10.0 + F.col("id") * 10).alias("x"), F.lit(None).cast("double").alias("y"))
    df = many.unionByName(line).unionByName(holes)
    near = [r.y for r in impute.knn(df, "y", ["x"], k=3).join(holes.select("x"), "x").filter("x > 10").collect()]
    assert len(near) == 38 and min(near) > 0
    filled = impute.pmm(df, "y", ["x"], seed=3)
    got = [(r.x, r.y) for r in filled.join(holes.select("x"), "x").collect()]
    assert filled.count() == 60_220 and len(got) == 40 and all(abs(y - 2 * (x - 10)) <= 8 for x, y in got)


def test_pmm_draws_from_the_nearest_donors_of_all_ranges(spark, monkeypatch):
    monkeypatch.setattr(impute, "MOST_DONORS", 50, raising=False)
    rng = np.random.Generator(np.random.PCG64(9))
    x = np.concatenate([rng.normal(size=500), [3.0] * 40, [-50.0, 50.0]])
    y = x * 3 + rng.normal(size=len(x))
    rows = [(i, float(a), None if i % 6 == 0 or i >= 540 else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "i int, x double, y double").repartition(7)
    given = [(a, b) for _, a, b in rows if b is not None]
    drawn = {r.i: r.y for r in impute.pmm(df, "y", ["x"], key=["i"]).collect()}
    ranks = set()
    for i, a, b in rows:
        if b is None:
            edge = sorted(abs(u - a) for u, _ in given)[4]
            assert drawn[i] in [v for u, v in given if abs(u - a) <= edge + 1e-9]
            ranks.add(sorted(given, key=lambda g: abs(g[0] - a)).index(next(g for g in given if g[1] == drawn[i])))
    assert len(drawn) == len(rows) and {0, 1, 2, 3, 4} <= ranks
    assert drawn == {r.i: r.y for r in impute.pmm(df.repartition(2), "y", ["x"], key=["i"]).collect()}


def test_contracts(spark):
    df = table(spark, k=[1, 2, 2], v=[1.0, 5.0, 9.0])
    c = contracts.new_contract("c").expect_unique("k").expect_range("v", 0, 10).expect_na_max("v", 0).expect_min_sample_size(3).expect_column_names("z")
    r = contracts.verify(c, df)
    assert [x["holds"] for x in r["rules"]] == [False, True, True, True, False] and not r["holds"]
    assert contracts.enforce(contracts.new_contract("e").expect_range("v", 0, 6), df).count() == 2
    assert c.digest() != contracts.new_contract("c").digest()


def test_mixture_and_optimisers(spark):
    rng = np.random.Generator(np.random.PCG64(7))
    v = np.concatenate([rng.normal(-3, 1, 500), rng.normal(4, 0.5, 500)])
    m = mixture.gmm(table(spark, v=v), ["v"], 2)
    assert sorted(m["means"][:, 0]) == pytest.approx([-3, 4], abs=0.2)
    rosen = lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2
    for method in ("bfgs", "nelder-mead"):
        np.testing.assert_allclose(optimize.minimize(rosen, [-1.0, 1.0], method, 2000)["par"], [1, 1], atol=1e-3)
    np.testing.assert_allclose(optimize.minimize(lambda p: ((p - 3) ** 2).sum(), [0.0, 0.0], "l-bfgs-b", upper=[2, 5])["par"], [2, 3], atol=1e-5)
    t = np.arange(10.0)
    np.testing.assert_allclose(optimize.least_squares(lambda p: p[0] * np.exp(-p[1] * t) - 3 * np.exp(-0.5 * t), [1.0, 1.0])["par"], [3, 0.5], rtol=1e-5)


def test_mixed_and_item_models(data, spark):
    df, _ = data
    m = multilevel.mixed_model(df, "y", ["x1", "x2"], "u")
    assert m["coef"][1] == pytest.approx(2, abs=0.1) and m["sigma2"] == pytest.approx(0.25, abs=0.05) and m["icc"] > 0.5
    assert multilevel.random_effects_of(m).count() == 20 and multilevel.design_effect(m)["design_effect"] > 1
    rng = np.random.Generator(np.random.PCG64(9))
    theta, b = rng.normal(size=1500), np.array([-1.0, 0.0, 0.5, 1.0])
    y = (rng.random((1500, 4)) < irt.probability(theta[:, None], 1.2, b)).astype(int)
    items = table(spark, **{f"i{k}": y[:, k] for k in range(4)}, g=np.arange(1500) % 2, th=theta)
    fit = irt.fit_dichotomous(items.select("i0", "i1", "i2", "i3"), ["i0", "i1", "i2", "i3"], "2pl", rounds=60)
    x, w = irt.quadrature(31)

    def log_lik(slopes, places):
        p = irt.probability(x[:, None], slopes, places)
        return np.log(np.exp(y @ np.log(p).T + (1 - y) @ np.log1p(-p).T) @ w).sum()

    # the estimates are likelier than the truth and than any small step away from them
    best = log_lik(fit["a"], fit["b"])
    assert np.corrcoef(fit["b"], b)[0, 1] > 0.98 and fit["log_lik"] == pytest.approx(best, abs=0.05) and best > log_lik(np.full(4, 1.2), b)
    for k in range(4):
        for d in (-0.15, 0.15):
            step = np.eye(4)[k] * d
            assert log_lik(fit["a"] + step, fit["b"]) < best + 0.02 and log_lik(fit["a"], fit["b"] + step) < best + 0.02
    scores = irt.score_persons(items, fit).agg(F.corr("theta", "th")).collect()[0][0]
    assert scores > 0.5
    assert {r["class"] for r in irt.mantel_haenszel_dif(items, ["i0", "i1"], "g", "th").collect()} <= {"A", "B"}
    assert irt.simulate_cat(fit, 0.5)["std_error"] < 1
    graded = irt.fit_polytomous(items.select((F.col("i0") + F.col("i1")).alias("p"), (F.col("i2") + F.col("i3")).alias("q"), (F.col("i1") + F.col("i2")).alias("r")), ["p", "q", "r"], rounds=5)
    assert all(np.diff(c).min() > 0 for c in graded["cuts"])
