"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> None:
    """Name a checkpoint folder, where the session hasn't one yet.

    A local master without the setting gets a temporary folder; on a cluster it is needed.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="stagewise-checkpoint-")
            atexit.register(shutil.rmtree, shared, True)
        sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder that the session names."""
    _shared(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the checkpoint folder."""
    _shared(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written as Parquet to the checkpoint folder (in folders of ``by``) and read back: computed once, where ``cut`` computes twice."""
    path = folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(table: DataFrame) -> None:
    """Delete a kept table (one without folders of its own) that nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
