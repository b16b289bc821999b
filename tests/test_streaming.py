from datetime import datetime

from pyspark.sql import functions as F

from quillon.queries import observation_log, observation_registry
from quillon.schema import LOG
from quillon.streaming import increments

SMALL = "/root/testdata/sf0.001"


def run(frame, mode, name, tmp_path):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.sql(f"SELECT * FROM {name}")


def test_tailing_the_log_maintains_indexes(spark, tmp_path):
    log = observation_log(spark, SMALL).limit(60)
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = increments.tail(spark, str(tmp_path / "log"), 1)
    q = increments.maintain_indexes(stream, observation_registry(), str(tmp_path / "index"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "index" / "token"))
    assert rows.where("param_name = 'code'").count() == 120
    assert spark.read.parquet(str(tmp_path / "index" / "reference")).select("target_type").distinct().collect()[0][0] == "Patient"


def test_versions_once(spark, tmp_path):
    log = observation_log(spark, SMALL).limit(20)
    log.write.parquet(str(tmp_path / "log"))
    log.write.mode("append").parquet(str(tmp_path / "log"))
    got = run(increments.distinct_versions(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")), "1000 days"), "append", "once", tmp_path)
    assert got.count() == 20


def test_windows_and_sessions(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    got = run(increments.window_counts(stream, "ts", "event_type", "1 day"), "complete", "daily", tmp_path)
    assert got.agg(F.sum("n")).first()[0] == events.count()
    assert got.count() == events.select(F.date_trunc("day", "ts"), "event_type").distinct().count()
    sessions = run(increments.session_counts(stream, "ts", "user_id", "6 hours"), "complete", "sessions", tmp_path)
    assert sessions.agg(F.sum("n")).first()[0] == events.count()


def test_streaming_last_n(spark, tmp_path):
    rows = [(k, "ab"[k % 2], datetime(2024, 1, 1 + k)) for k in range(10)]
    spark.createDataFrame(rows, "fhir_id int, code string, at timestamp").repartition(4).write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema("fhir_id int, code string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    got = run(increments.streaming_last_n(stream, "code", "at", 2), "update", "lastn", tmp_path)
    best = {(r.code, r.fhir_id) for r in got.collect()}
    assert {("a", "8"), ("a", "6"), ("b", "9"), ("b", "7")} <= best
