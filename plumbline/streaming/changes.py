"""Change streams: volumes per window, debounced sessions, deduplication and keyed change detection on Structured Streaming.

Every transformation works on a batch and on a stream; a stream needs a watermark, which ``watched`` sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watched(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events with a watermark on ``ts``, which is read as UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def volume(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Changes per window and event type."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")) if not events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("changes")).select(F.col("w.start").alias("window_start"), "event_type", "changes")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of events of a type, closed by a pause of ``gap``: a reload is due once for each."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")) if not events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "event_type").agg(F.count("*").alias("events")).select("event_type", F.col("w.start").alias("session_start"), "events")


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def slot_of(path):
    """Graph kind that a changed file's name stands for: domain, knowledge, else codebase."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.contains("domain"), "domain").when(name.contains("knowledge"), "knowledge").otherwise("codebase")


def file_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 16) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def changed_only(now: DataFrame, state: DataFrame) -> DataFrame:
    """Rows (path, hash) of a batch that are new or whose stored hash is another one; the last row of a path counts."""
    last = now.groupBy("path").agg(F.max_by("hash", "at").alias("hash"), F.max("at").alias("at"))
    return last.join(state.select("path", F.col("hash").alias("was")), "path", "left").where("was is null or was <> hash").drop("was")


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to ``handle`` and end when all that is there has been read; restarts go on from the checkpoint."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
