from tidemill.streaming import windows


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:{10 + i % 40}:00", i % 4, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string, k int, v double").selectExpr("id", "cast(t as timestamp) as t", "k", "v")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, "t", "1 hour", ["k"]).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("tumbled").collect()))
    assert got == sorted(map(tuple, windows.tumbling(df, "t", "1 hour", ["k"]).collect())) and len(got) == 12
    assert windows.sessions(df, "t", "2 minutes", ["k"]).count() >= 4
    assert windows.sliding(df, "t", "2 hours", "1 hour").count() == 4


def test_running_totals(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "k int, v double")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windows.running_totals(stream, "k", "v").writeStream.format("memory").queryName("totals").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("totals").collect():
        last[r.k] = max(last.get(r.k, (0, 0.0)), (r.n, r.total))
    assert last == {r.k: (r.n, r.total) for r in windows.running_totals(df, "k", "v").collect()}
