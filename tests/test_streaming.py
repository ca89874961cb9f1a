"""Streams against the batch answer."""

from chronoward.streaming import streams

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def source(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    return streams.read_events(spark, str(tmp_path / "in"), SCHEMA).selectExpr("user_id", "CAST(ts AS TIMESTAMP) AS ts", "value", "value > 50 AS high")


def test_hourly_and_sessions(spark, sf_dir, tmp_path):
    stream = source(spark, sf_dir, tmp_path)
    hourly = drain(streams.hourly(stream, "user_id", "ts", "value"), "hourly", "complete")
    assert hourly.selectExpr("sum(n)").first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    sessions = drain(streams.sessions(stream, "user_id", "ts", "12 hours"), "sessions", "complete")
    assert sessions.count() > 0


def test_consensus(spark, sf_dir, tmp_path):
    from chronoward.operators import machine

    got = drain(streams.consensus(source(spark, sf_dir, tmp_path), "user_id", "ts", "high", 15), "consensus", "append")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "ts", "value > 50 AS high", "false AS stop")
    events = machine.consensus_events(batch, "user_id", "ts", "high", "stop", 15, 15)
    assert got.where("state").count() == events.where("_on_event = 1").count()
    assert got.where("NOT state").count() == events.where("_off_event = 1").count()
