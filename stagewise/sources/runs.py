"""Run checkpoints, resume, reports and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagewise import schema as S


def last_record(records: DataFrame, arrival: str, key: str = "user_id") -> DataFrame:
    """The last record per key in order of arrival; ids compare as text."""
    w = W.partitionBy(F.col(key).cast("string")).orderBy(F.desc(arrival))
    return records.withColumn("stagewise_nth", F.row_number().over(w)).where("stagewise_nth = 1").drop("stagewise_nth")


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, bad ones skipped, last record per user.

    Files are taken in order of their modification and name, lines in order of their
    place in a file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    rows = lines.select("at", "file", "line", F.from_json("value", S.CHECKPOINT, {"mode": "PERMISSIVE"}).alias("r")).where("r.user_id is not null")
    return last_record(rows.select(F.struct("at", "file", "line").alias("arrival"), "r.*"), "arrival").drop("arrival")


def append_checkpoint(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def pending(users: DataFrame, done: DataFrame) -> DataFrame:
    """Users without a record yet."""
    return users.join(done.select(F.col("user_id").cast("string").alias("done_id")), F.col("user_id").cast("string") == F.col("done_id"), "left_anti")


def finalise(spark: SparkSession, path: str, target: str) -> DataFrame:
    """The checkpoint's last records as Parquet."""
    read_checkpoint(spark, path).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def reconcile(per_user: DataFrame, published: DataFrame, tolerance: float = 5e-5) -> DataFrame:
    """name, n, mean, published mean and whether they agree. per_user: name, value; published: name, expected."""
    means = per_user.groupBy("name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return published.join(means, "name", "left").select("name", "n", "mean", "expected", (F.coalesce(F.abs(F.col("mean") - F.col("expected")) <= tolerance, F.lit(False))).alias("agrees"))


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, bytes and sha256 of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def id_collisions(records: DataFrame) -> DataFrame:
    """Ids that occur in more than one spelling of the same number."""
    rows = records.select(F.col("user_id").cast("string").alias("as_text")).distinct()
    return rows.groupBy(F.expr("try_cast(as_text as bigint)").alias("as_number")).agg(F.count("*").alias("n")).where("n > 1 and as_number is not null")


def finite(value: Column) -> Column:
    """NaN and infinities as null: a report holds none of them."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document per row under its keys, with numbers made finite."""
    doubles = {c: finite(F.col(c)) for c, t in rows.dtypes if t in ("double", "float")}
    clean = rows.withColumns(doubles) if doubles else rows
    return clean.select(*keys, F.to_json(F.struct(*[c for c in rows.columns if c not in keys])).alias("report"))


def history_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def cost(records: DataFrame, prices: DataFrame) -> DataFrame:
    """model, calls, tokens in and out, USD. prices: model, usd_in, usd_out per million."""
    g = records.groupBy("model").agg(F.count("*").alias("calls"), F.sum("n_in").alias("tokens_in"), F.sum("n_out").alias("tokens_out"))
    return g.join(prices, "model").select("model", "calls", "tokens_in", "tokens_out", ((F.col("tokens_in") * F.col("usd_in") + F.col("tokens_out") * F.col("usd_out")) / 1e6).alias("usd"))
