from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarrygraph.operators.incremental import latest_wins
from quarrygraph.streaming import activity

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def write(spark, folder, minutes):
    rows = [(i, START + timedelta(minutes=m), i % 2, "click", 1.0, "{}") for i, m in enumerate(minutes)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_hourly_and_late_rows(spark, tmp_path):
    write(spark, tmp_path / "e", [0, 10, 70, 600])
    got = activity.run_once(spark, str(tmp_path / "e"), spark.createDataFrame([], SCHEMA).schema, activity.hourly).collect()
    assert sorted((r.window_start.hour, r.n) for r in got) == [(0, 2), (1, 1), (10, 1)]
    stream = activity.events(spark, str(tmp_path / "e"), spark.createDataFrame([], SCHEMA).schema)
    closed = drain(activity.hourly(stream), "closed")
    assert sorted(r.window_start.hour for r in closed.collect()) == [0, 1]  # the last hour is still open


def test_sliding_and_sessions(spark, tmp_path):
    write(spark, tmp_path / "e", [0, 10, 20, 100, 700])
    schema = spark.createDataFrame([], SCHEMA).schema
    s = activity.run_once(spark, str(tmp_path / "e"), schema, activity.sliding)
    assert s.agg({"n": "sum"}).first()[0] == 5 * 4
    got = drain(activity.sessions(activity.events(spark, str(tmp_path / "e"), schema)), "sess").collect()
    assert sorted((r.user_id, r.started.hour * 60 + r.started.minute, r.n) for r in got) == [(0, 0, 2), (1, 10, 1), (1, 100, 1)]


def test_decayed_scores(spark, tmp_path):
    write(spark, tmp_path / "e", [0, 24 * 60, 48 * 60])
    got = drain(activity.decayed_hotspots(activity.events(spark, str(tmp_path / "e"), spark.createDataFrame([], SCHEMA).schema), 1.0), "hot", "update").collect()
    assert {r.user_id: round(r.score, 6) for r in got} == {0: 1.25, 1: 1.0}


def test_upserts(spark, tmp_path):
    write(spark, tmp_path / "e", [0, 1, 2])
    kept = {}

    def apply(batch, _):
        fresh = batch.groupBy("user_id").count()
        old = kept.get("t")
        kept["t"] = (fresh if old is None else latest_wins(old, fresh, ["user_id"])).persist()
        kept["t"].count()

    activity.upserts(activity.events(spark, str(tmp_path / "e"), spark.createDataFrame([], SCHEMA).schema), apply, str(tmp_path / "c")).awaitTermination()
    assert {r["user_id"]: r["count"] for r in kept["t"].collect()} == {0: 2, 1: 1}


def test_a_table_run_once_is_written_by_tasks(spark, tmp_path):
    """The result is files in the shared folder, not rows in the driver; none for no events."""
    rows = [(i, i % 5, i * 1000) for i in range(500)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    for name, table in (("some", made), ("none", made.limit(0))):
        path = str(tmp_path / name)
        table.write.parquet(path)
        got = activity.run_once(spark, path, table.schema, activity.sessions)
        assert got.inputFiles() and all("/streams/" in f for f in got.inputFiles())
        assert sum(r.n for r in got.collect()) == table.count()
