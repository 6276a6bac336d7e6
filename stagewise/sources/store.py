"""A checkpoint store that a stream saves to by itself: batches, a commit log, resume, finalise, cleanup.

``records/stagewise_batch=N`` holds what batch N brought and ``commits/batch=N`` says that it is whole.
Both are overwritten when a batch is run again, so a stream that was killed between the two,
or within either, leaves nothing twice and nothing half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stagewise.sources import runs

COMMIT = "batch long, n long, saved_at timestamp"


class CheckpointStore:
    """Records of finished items under a folder that all executors reach.

    spark, path; schema: of the records; key: the item; arrival: a column that orders the
    records of an item (the last one holds; ties go to the later batch).
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "user_id", arrival: str = "ts") -> None:
        self.spark, self.path, self.schema, self.key, self.arrival = spark, path.rstrip("/"), schema, key, arrival

    def _exists(self, part: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def save(self, records: DataFrame, batch: int) -> None:
        """Records, then their commit. A batch saved before is replaced; it is written once and counted from what was written."""
        target = f"{self.path}/records/stagewise_batch={batch}"
        records.select(*self.schema.names).write.mode("overwrite").parquet(target)
        n = self.spark.read.schema(self.schema).parquet(target).agg(F.lit(batch).cast("long").alias("number"), F.count("*").alias("n"), F.current_timestamp().alias("saved_at"))
        n.select(F.col("number").alias("batch"), "n", "saved_at").write.mode("overwrite").json(f"{self.path}/commits/batch={batch}")

    def save_stream(self, records: DataFrame, every: str | None = None) -> StreamingQuery:
        """Start saving a stream: a batch every ``every``, or all there is now and then stop.

        The stream's own position lies beside the records, so that the same call resumes it.
        """
        writer = records.writeStream.foreachBatch(lambda part, batch: self.save(part, batch)).option("checkpointLocation", f"{self.path}/position")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def commits(self) -> DataFrame:
        """batch, n, saved_at of every whole batch."""
        if not self._exists("commits"):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true").json(f"{self.path}/commits")

    def records(self) -> DataFrame:
        """Committed records, the last of each item."""
        if not self._exists("records"):
            return self.spark.createDataFrame([], self.schema)
        typed = StructType(list(self.schema.fields)).add("stagewise_batch", "long")
        whole = self.commits().select(F.col("batch").alias("stagewise_batch"))
        rows = self.spark.read.schema(typed).parquet(f"{self.path}/records").join(whole, "stagewise_batch", "left_semi")
        last = runs.last_record(rows.withColumn("stagewise_arrival", F.struct(self.arrival, "stagewise_batch")), "stagewise_arrival", self.key)
        return last.select(*self.schema.names)

    def pending(self, items: DataFrame) -> DataFrame:
        """Items without a committed record."""
        done = self.records().select(F.col(self.key).cast("string").alias("done_id"))
        return items.join(done, F.col(self.key).cast("string") == F.col("done_id"), "left_anti")

    def progress(self, items: DataFrame) -> DataFrame:
        """completed, total and their percentage, as one row; null of nothing."""
        left = self.pending(items).agg(F.count("*").alias("left"))
        g = items.agg(F.count("*").alias("total")).join(F.broadcast(left))
        return g.select((F.col("total") - F.col("left")).alias("completed"), "total", F.round(100 * (F.col("total") - F.col("left")) / F.nullif("total", F.lit(0)), 1).alias("percent"))

    def finalise(self, target: str) -> DataFrame:
        """The records as one Parquet table, with nothing uncommitted in it."""
        self.records().write.mode("overwrite").parquet(target)
        return self.spark.read.schema(self.schema).parquet(target)

    def cleanup(self) -> None:
        """Delete the store (after ``finalise``)."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
