from pyspark.sql import functions as F

from medloom.operators import sessions
from medloom.sources import writers
from medloom.streaming import flows

ITEMS = "session string, key string, status string, confidence double, score double, text string, quality string, n int"


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def test_merge_equals_batch(spark, tmp_path):
    data = [(f"s{i % 5}", f"k{i % 3}", "confirmed" if i % 7 == 0 else f"state{i}", i / 100, i / 200, None if i % 4 == 0 else f"t{i}", "GOOD" if i % 3 else "WARNING", 100 - i) for i in range(60)]
    df = spark.createDataFrame(data, ITEMS)
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = drain(flows.merge_sessions(stream), "merged", "update").groupBy("session", "key").agg(F.max_by(F.struct("frequency", "confidence", "score", "status", "text", "qualities"), "frequency").alias("r")).select("session", "key", "r.*")
    want = sessions.merge_items(df, "session", "key", ["n"]).select("session", "key", "frequency", "confidence", "score", "status", "text", "qualities")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_log_that_arrives_late_still_counts(spark, tmp_path):
    at = lambda m: f"2026-01-01 {2 + m // 60:02d}:{m % 60:02d}:00"
    doses = spark.createDataFrame([("a", at(0)), ("b", at(5)), ("far", at(600))], "occurrence string, t string").select("occurrence", F.to_timestamp("t").alias("scheduled"))
    doses.coalesce(1).write.parquet(str(tmp_path / "doses"))
    for n, rows in enumerate(([("x", at(40))], [("a", at(10))], [("far", at(600)), ("y", at(720))], [("z", at(900))])):  # the entry of a comes after one that is later
        spark.createDataFrame(rows, "log_occurrence string, t string").select("log_occurrence", F.to_timestamp("t").alias("logged")).coalesce(1).write.parquet(str(tmp_path / "all" / str(n)))
    logs = spark.readStream.schema("log_occurrence string, logged timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all" / "*"))
    more = spark.createDataFrame([("later", at(1000))], "occurrence string, t string").select("occurrence", F.to_timestamp("t").alias("scheduled"))
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "doses"))
    stream = spark.readStream.schema(doses.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "doses"))
    missed = {r.occurrence for r in drain(flows.missed_doses(stream, logs), "missed").collect()}
    assert "b" in missed and not missed & {"a", "far"}


def test_rate_windows_equal_batch(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = flows.rate_windows(stream, "ts", ["user_id"], 0, "6 hours", "1 hour")
    # The last window stays open until later data passes its end, so it is left out on both sides.
    end = events.agg(F.max("ts")).first()[0]
    batch = events.groupBy(F.window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).where(F.col("w.end") < F.lit(end) - F.expr("INTERVAL 1 HOUR"))
    got = {(r.user_id, r.start, r.n) for r in drain(out, "rates").collect()}
    assert got >= {(r.user_id, r.w.start, r.n) for r in batch.collect()} and got


def test_upsert_sink_replays(spark, tmp_path):
    df = spark.createDataFrame([("o1", 1, "skipped"), ("o1", 2, "taken"), ("o2", 1, "missed")], "id string, n int, status string")
    df.write.parquet(str(tmp_path / "in"))
    for k in range(2):  # a second query replays everything
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        flows.upsert_sink(stream, str(tmp_path / "out"), str(tmp_path / f"ck{k}"), ["id"], "n").awaitTermination(120)
    assert sorted(map(tuple, writers.current(spark, str(tmp_path / "out")).collect())) == [("o1", 2, "taken"), ("o2", 1, "missed")]


def test_late_and_expiry(spark):
    status = spark.createDataFrame([("a", "pending"), ("b", "taken")], "id string, status string")
    late = spark.createDataFrame([("a", "skipped")], "id string, status string")
    assert sorted(map(tuple, flows.with_late(status, late, "id").collect())) == [("a", "skipped"), ("b", "taken")]
    cache = spark.createDataFrame([("2026-01-02",), ("2026-01-01",)], "t string").select(F.to_timestamp("t").alias("expires_at"))
    assert flows.unexpired(cache, "2026-01-01").count() == 1
