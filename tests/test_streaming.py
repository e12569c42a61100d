from marlspike.streaming import events


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    df = spark.range(100).selectExpr("timestamp_seconds(id * 60) as ts", "cast(id % 2 as string) as k", "cast(id as double) as v")
    df.write.parquet(source)
    aggregates = [("count",), ("sum", "v")]
    stream = events.windowed(spark.readStream.schema(df.schema).parquet(source), "ts", "10 minutes", ["k"], aggregates)
    query = stream.writeStream.format("memory").queryName("out").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("out").collect()))
    assert got == sorted(map(tuple, events.windowed(df, "ts", "10 minutes", ["k"], aggregates).collect()))
    assert len(got) == 20


def test_sessions_and_sizes(spark):
    df = spark.createDataFrame([("a", 0), ("a", 30), ("a", 500)], "k string, s long").selectExpr("k", "timestamp_seconds(s) as ts")
    assert sorted(r["count"] for r in events.sessions(df, "ts", "1 minute", ["k"], [("count",)]).collect()) == [1, 2]
    assert events.optimal_partitions(df) == 1
