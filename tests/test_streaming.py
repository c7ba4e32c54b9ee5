"""Streams give what their batch form gives."""

import pytest

from tideglass.streaming import windows


@pytest.fixture()
def events(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 20:02d}:{i % 60:02d}:00", i % 7, "view", float(i), "{}") for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df = df.withColumn("ts", df["ts"].cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_windows_equal_batch(spark, events, tmp_path):
    stream = windows.rate_windows(spark.readStream.schema(windows.SCHEMA).parquet(events), late="30 days")
    query = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = windows.rate_windows(spark.read.parquet(events))
    assert sorted(map(str, spark.table("w").collect())) == sorted(map(str, batch.collect()))


def test_append_sink_writes_closed_windows_once(spark, events, tmp_path):
    stream = windows.rate_windows(spark.readStream.schema(windows.SCHEMA).option("maxFilesPerTrigger", 1).parquet(events), late="1 minute")
    table = windows.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert table.count() == table.select("start", "user_id").distinct().count()


def test_update_batches_keep_every_row(spark, events, tmp_path):
    windows.stream_updates(spark.readStream.schema(windows.SCHEMA).parquet(events), str(tmp_path / "u"), str(tmp_path / "c"), size=30)
    got = spark.read.parquet(str(tmp_path / "u"))
    assert got.agg({"n": "sum"}).first()[0] == 400 and got.agg({"n": "max"}).first()[0] <= 30
