import itertools

import pytest
from pyspark.sql import functions as F

from tidemill.errors import ComputeError, StatError
from tidemill.frame import Frame, desc
from tidemill.operators import aggregates as A
from tidemill.sources.files import frame_of, parse_csv, read_csv, write_csv
from tidemill.sources.sql import connect, query_sql


@pytest.fixture(scope="module")
def xyz(spark):
    return frame_of(spark, {"i": [0, 1, 2, 3, 4], "g": ["a", "b", "a", None, "b"], "x": [1.0, None, 3.0, 4.0, None]}).order_by("i")


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_kleene_truth_table(spark):
    values = [True, False, None]
    pairs = list(itertools.product(values, values))
    f = frame_of(spark, {"i": list(range(9)), "a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}).order_by("i")
    got = rows(f.mutate(o=F.col("a") | F.col("b"), n=F.col("a") & F.col("b"), t=~F.col("a")).select("o", "n", "t"))

    def either(a, b):
        return True if True in (a, b) else None if None in (a, b) else False

    def both(a, b):
        return False if False in (a, b) else None if None in (a, b) else True

    assert got == [(either(a, b), both(a, b), None if a is None else not a) for a, b in pairs]


def test_filter_drops_unknown_and_rejects_values(xyz):
    assert rows(xyz.filter(F.col("x") > 2).select("i")) == [(2,), (3,)]
    with pytest.raises(ComputeError, match="C0202"):
        xyz.filter(True)


def test_errors_name_their_code(xyz):
    with pytest.raises(StatError, match="S0201"):
        xyz.select("nope")
    with pytest.raises(ComputeError, match="C0206"):
        xyz.rename("i", "x")
    assert xyz.drop("nope", "g").columns == ["i", "x"]


def test_aggregates_propagate_missing(xyz):
    got = {r[0]: r[1:] for r in rows(xyz.group_by("g").summarize(m=A.mean("x"), k=A.mean("x", skip_na=True), n=A.count(), d=A.n_distinct("x"), f=A.first("x"), l=A.last("x")))}
    assert got == {"a": (2.0, 2.0, 2, 2, 1.0, 3.0), "b": (None, None, 2, 1, None, None), None: (4.0, 4.0, 1, 1, 4.0, 4.0)}
    assert [r[0] for r in rows(xyz.group_by("g").summarize(n=A.count()))] == ["a", "b", None]


def test_order_verbs(xyz):
    assert rows(xyz.head(2).select("i")) == [(0,), (1,)]
    assert sorted(rows(xyz.tail(2).select("i"))) == [(3,), (4,)]
    assert rows(xyz.slice(1, 3).select("i")) == [(1,), (2,)]
    assert rows(xyz.slice(3, 3).select("i")) == []
    assert rows(xyz.slice_max("x", 2).select("i")) == [(2,), (3,)]
    assert [r[0] for r in xyz.arrange(desc("x")).df.select("i").collect()] == [3, 2, 0, 1, 4]
    assert rows(xyz.distinct("g").select("i")) == [(0,), (1,), (3,)]
    assert xyz.sample_n(3, 1).nrow() == 3 and rows(xyz.sample_n(3, 1)) == rows(xyz.sample_n(3, 1))
    assert xyz.sample_frac(0.4).nrow() == 2


def test_windows(xyz):
    assert rows(xyz.lag("x", "p").select("p")) == [(None,), (1.0,), (None,), (3.0,), (4.0,)]
    assert rows(xyz.cumulate("x", "s").select("s")) == [(1.0,), (None,), (None,), (None,), (None,)]
    assert rows(xyz.fill_na("x", 0.0).rank("x", "r").select("r")) == [(3.0,), (1.5,), (4.0,), (5.0,), (1.5,)]


def test_joins_suffix_and_missing_keys(spark, xyz):
    other = frame_of(spark, {"g": ["a", None], "x": [10.0, 20.0], "y": [1, 2]})
    inner = xyz.inner_join(other, "g")
    assert inner.columns == ["g", "i", "x", "x_right", "y"]
    assert sorted(r.i for r in inner.collect()) == [0, 2]
    assert xyz.left_join(other, "g").nrow() == 5
    assert sorted(r.i for r in xyz.join(other, "g", how="left_anti").collect()) == [1, 3, 4]


def test_reasons_travel(spark, xyz):
    f = xyz.with_reasons("x", F.lit("lost"))
    kept = f.filter(F.col("g") == "b").rename("x", "z")
    assert [r[0] for r in kept.na_reasons("z").collect()] == ["lost", "lost"]
    other = frame_of(spark, {"g": ["b"], "w": [1]})
    assert [r.reason for r in f.inner_join(other, "g").pull("x").collect()] == ["lost", "lost"]
    assert f.filter_na_reason("x", drop=["lost"]).nrow() == 3
    assert f.filter_na_reason("x", keep=["lost"]).nrow() == 5
    assert f.impute("x", "mean", only_for=["other"]).filter(F.col("x").isNull()).nrow() == 2
    assert rows(f.impute("x", "const", value=9.0).select("x"))[1] == (9.0,)
    assert rows(f.fill_na("x", "none").select("x"))[1] == ("none",)
    assert f.lag("x", "p").na_reasons("p").filter("reason = 'lost'").count() == 1


def test_pivot_round_trip(spark):
    f = frame_of(spark, {"id": [1, 1, 2, 1], "v": ["p", "q", "p", "p"], "s": [1.0, 2.0, 3.0, 9.0], "k": [0, 1, 2, 3]}).order_by("k")
    wide = f.pivot_wider("v", "s", ["id"])
    assert wide.columns == ["id", "p", "q"]
    assert sorted(rows(wide)) == [(1, 1.0, 2.0), (2, 3.0, None)]
    long = wide.order_by("id").pivot_longer(["p", "q"], id_cols=["id"])
    assert rows(long) == [(1, "p", 1.0), (2, "p", 3.0), (1, "q", 2.0), (2, "q", None)]
    with pytest.raises(ComputeError):
        f.select("v", "s").pivot_wider("v", "s")


def test_asof_join(spark):
    left = frame_of(spark, {"t": [1, 5, 9], "k": ["a", "a", "b"]})
    right = frame_of(spark, {"t": [0, 4, 6], "k": ["a", "a", "a"], "v": [10, 40, 60]})
    assert sorted((r.t, r.v) for r in left.asof_join(right, "t", ["k"]).collect()) == [(1, 10), (5, 40), (9, None)]


def test_csv_types_reasons_and_round_trip(spark, tmp_path):
    text = 'id,name,score,active,big,empty\n1,"a, b",1.5,true,1,\n2,NA:absent,NA:SensorDropout,false,99999999999999999999,NA\n3,c,NaN,true,3,\n'
    f = parse_csv(spark, text)
    assert dict(f.to_spark().dtypes) == {"id": "bigint", "name": "string", "score": "double", "active": "boolean", "big": "double", "empty": "double"}
    assert [r.reason for r in f.order_by("id").pull("score").collect()] == [None, "SensorDropout", None]
    write_csv(f, str(tmp_path / "out"))
    back = read_csv(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, f.collect()))
    assert back.na_reasons("score").filter("reason = 'SensorDropout'").count() == 1
    with pytest.raises(ComputeError, match="C0403"):
        parse_csv(spark, "a,b\n1\n")


def test_literal_widening(spark):
    f = frame_of(spark, {"a": [1, 2.5], "b": [True, "x"], "c": [None, None], "d": [True, 2]})
    assert dict(f.to_spark().dtypes) == {"a": "double", "b": "string", "c": "double", "d": "bigint"}


def test_sql_and_connections(spark, tmp_path):
    f = frame_of(spark, {"id": [1, 2, 3], "v": [1.0, None, 3.0]})
    assert rows(query_sql(spark, "SELECT count(*) AS n FROM df WHERE v > 0", f)) == [(2,)]
    db = connect(spark, "sqlite", str(tmp_path / "x.db"))
    db.register("t", f)
    db.register("t", f)
    assert db.tables() == ["t"]
    got = db.query("SELECT id, v FROM t WHERE id >= 2 ORDER BY id")
    assert got.nrow() == 4 and got.na_reasons("v").filter("reason = 'db.null'").count() == 2
    assert db.execute("DELETE FROM t WHERE id = 1") == 2
    db.close()
    with pytest.raises(ComputeError, match="C0305"):
        db.tables()
    memory = connect(spark)
    memory.register("s", f)
    assert rows(memory.query("SELECT max(id) AS m FROM s")) == [(3,)]


def test_empty_frames(spark):
    f = Frame(spark.createDataFrame([], "g string, x double"))
    assert f.group_by("g").summarize(m=A.mean("x")).nrow() == 0
    assert f.head(3).nrow() == 0 and f.distinct("g").nrow() == 0
    assert f.impute("x", "mean").nrow() == 0


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id", "id % 7 as k")
    draws = [sorted(r.id for r in Frame(df.repartition(p)).sample_n(20, seed=4).to_spark().collect()) for p in (1, 7)]
    assert draws[0] == draws[1] and len(set(draws[0])) == 20
    assert Frame(df.limit(5)).sample_frac(0.5).nrow() == 3 and Frame(df).sample_n(0).nrow() == 0


def test_filling_all_columns_of_different_kinds(spark):
    df = spark.createDataFrame([(1, "a", 1.5, True), (None, None, None, None)], "i int, s string, d double, b boolean")
    assert tuple(Frame(df).fill_na_all(0).to_spark().collect()[1]) == (0, "0", 0.0, None)
    assert tuple(Frame(df).fill_na_all(2.5).to_spark().select("i", "s", "d").collect()[1]) == (2.5, "2.5", 2.5)
    assert tuple(Frame(df).fill_na_all("x").to_spark().collect()[1]) == ("x", "x", "x", "x")
    assert tuple(Frame(df).fill_na_all(False).to_spark().select("b", "d").collect()[1]) == (False, None)


def test_as_of_join_with_missing_keys_and_times(spark):
    left = spark.createDataFrame([(1, 5), (1, None), (None, 5), (2, 5)], "k int, t int")
    right = Frame(spark.createDataFrame([(1, None, 10.0), (None, 3, 11.0), (1, 4, None), (2, 6, 12.0)], "k int, t int, v double")).with_reasons("v", F.lit("lost"))
    out = Frame(left).asof_join(right, "t", ["k"])
    got = {(r.k, r.t): (r.t_right, r.v, r["__na__v"]) for r in out.df.collect()}
    assert got == {(1, 5): (4, None, "lost"), (1, None): (None,) * 3, (None, 5): (None,) * 3, (2, 5): (None,) * 3}


def test_whole_table_windows_against_one_window(spark, monkeypatch):
    from tidemill.operators import ranges

    monkeypatch.setattr(ranges, "CHUNK", 7)
    rows = [(i, (i * 37) % 11, None if i in (60, 75) else float(i % 5)) for i in range(100)]
    df = spark.createDataFrame(rows, "i int, k int, v double").repartition(6)
    f = Frame(df).order_by("i").with_reasons("v", F.concat(F.lit("r"), "i"))
    got = {r.i: r for r in f.lag("v", "b", 3).lead("k", "a", 2).cumulate("v", "s").cumulate("k", "p", "max").rank("k", "r").df.collect()}
    v, k = [r[2] for r in rows], [r[1] for r in rows]
    for i in range(100):
        r = got[i]
        assert (r.b, r["__na__b"]) == ((v[i - 3], None if v[i - 3] is not None else f"r{i - 3}") if i >= 3 else (None, None))
        assert r.a == (k[i + 2] if i < 98 else None) and r.p == max(k[: i + 1])
        assert (r.s, r["__na__s"]) == ((sum(v[: i + 1]), None) if i < 60 else (None, "r60"))
        assert r.r == sum(x < k[i] for x in k) + (k.count(k[i]) + 1) / 2
    assert Frame(df.limit(0)).order_by("i").lag("v", "b").cumulate("k", "p").rank("k", "r").nrow() == 0
