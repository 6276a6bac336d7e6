"""Checkpoint logs and event windows as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table_stream(spark: SparkSession, path: str, schema: StructType, files: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream, ``files`` of them a step at most."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def latest_per_user(log: DataFrame, arrival: str = "ts") -> DataFrame:
    """user_id and its last record so far (use output mode complete or update)."""
    return log.groupBy("user_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "user_id"]), arrival).alias("r")).select("user_id", "r.*")


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and event type. An extension: the studied system has no event time."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("begin"), "event_type", "n", F.round("total", 6).alias("total"))


def sliding(events: DataFrame, size: str = "1 hour", every: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per overlapping window and event type; as a stream, rows behind the watermark are left out. An extension."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, every), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("begin"), "event_type", "n", F.round("total", 6).alias("total"))


def first_records(log: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first record of each key, for logs that append a record again after a restart.

    A stream keeps a key until the watermark has passed its record by ``late``, so its state
    is bounded; a repetition later than that counts as new. A table keeps one record a key.
    """
    if log.isStreaming:
        return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ts").alias("r")).select(*keys, "r.*").select(*log.columns)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per user by a gap. An extension."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def run_to_memory(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Drive a stream over what there is and return the collected table (for tests and small results)."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
