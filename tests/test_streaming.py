from pyspark.sql import functions as F

from sievework.operators import state
from sievework.streaming import cooldown
from sievework.streaming.health import health

SF = "/root/testdata/sf0.001"


def test_stream_counts_as_the_table_does(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id % 8 AS provider", "CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS outcome", "value AS duration_ms", "ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = health(stream).writeStream.format("memory").queryName("health").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = spark.table("health")
        want = health(rows)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
        assert want.agg(F.sum("attempts")).first()[0] == rows.count()
    finally:
        q.stop()


def _stream(df, path):
    df.coalesce(1).write.parquet(str(path / "in"))
    return df.sparkSession.readStream.schema(df.schema).parquet(str(path / "in"))


def _run(df, name, path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path / "cp")).start()
    try:
        q.processAllAvailable()
        return df.sparkSession.table(name).collect()
    finally:
        q.stop()


def test_stream_rests_as_the_table_does(spark, tmp_path):
    calls = spark.read.parquet(f"{SF}/events.parquet").selectExpr(
        "cast(user_id % 8 AS string) AS provider", "event_id AS call_id", "ts", "event_type IN ('error', 'click', 'view') AS failed", "CASE event_id % 4 WHEN 0 THEN 'blocked' ELSE 'timeout' END AS class"
    )
    got = {tuple(r) for r in _run(cooldown.rests(_stream(calls, tmp_path)), "rests", tmp_path)}
    want = {tuple(r) for r in state.cooldowns(calls).select("provider", "call_id", F.unix_micros("start"), F.unix_micros("until")).collect()}
    assert got == want and got


def test_single_flight_lets_one_call_through(spark, tmp_path):
    calls = spark.createDataFrame([("a", 1), ("a", 5), ("b", 6), (None, 7), (None, 8)], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    got = [r.key for r in _run(cooldown.single_flight(_stream(calls, tmp_path)), "single", tmp_path)]
    assert sorted(got, key=str) == [None, "a", "b"]
