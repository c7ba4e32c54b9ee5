"""Event-time windows and a priority queue over event streams, in Structured Streaming and in batch.

The batch form of a stream operator is the same transformation over a table, so results can be compared.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions.sqlop import Op

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
PRIORITY = {"purchase": 0, "error": 1, "signup": 2}


def rate_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours", limit: int = 3) -> DataFrame:
    """Requests of each user by tumbling window, and whether a limit was passed; late events are waited for."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counted = timed.groupBy(F.window("ts", length).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "user_id", F.col("n").cast("bigint").alias("n"), F.round("total", 6).alias("total"), (F.col("n") > limit).alias("limited"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything that is there now goes through the stream, exactly once, into a Parquet table."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def update_batches(events: DataFrame, size: int = 500) -> DataFrame:
    """Updates in batches of at most `size` by type, urgent types first: event_type, batch, priority, n."""
    from pyspark.sql import Window

    order = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    # Dealt into shares by hash, so a type with most of the updates is numbered in many places.
    dealt = events.withColumn("share", F.pmod(F.xxhash64("event_id"), F.lit(16)))
    numbered = dealt.withColumn("rn", F.row_number().over(Window.partitionBy("event_type", "share").orderBy("event_id")) - 1)
    batches = numbered.groupBy("event_type", "share", F.floor(F.col("rn") / size).alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    return batches.select("event_type", "share", "batch", F.coalesce(order[F.col("event_type")], F.lit(3)).cast("bigint").alias("priority"), F.col("n").cast("bigint").alias("n"))


def stream_updates(stream: DataFrame, path: str, checkpoint: str, size: int = 500) -> None:
    """Each micro-batch is grouped by type and written under its number, so a replay overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        update_batches(batch, size).write.mode("overwrite").parquet(os.path.join(path, f"batch={number}"))

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def streamed_windows(spark, sf_dir: str) -> DataFrame:
    """rate_windows over the events table read as a stream, in update mode through memory."""
    stream = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet")
    name = f"windows_{uuid.uuid4().hex}"
    query = rate_windows(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


OPS = {
    "n02_abandoned_jobs": Op("Gaps between a worker's heartbeats that are long enough to take its job away.", "SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events}) AS g WHERE before IS NOT NULL AND ts > before + INTERVAL 12 HOUR"),
    "n06_notifications": Op("Alerts above a threshold, newest of each type.", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM {events} WHERE value > :threshold) AS r WHERE rn <= :top", threshold=95, top=5),
}
_WINDOWS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, user_id, count(*) AS n, round(sum(value), 6) AS total, count(*) > 3 AS limited FROM events GROUP BY 1, user_id"
FUNCTIONS = {
    "n01_update_batches": (update_batches, ["events"], None),
    "n04_rate_windows": (rate_windows, ["events"], _WINDOWS),
}
