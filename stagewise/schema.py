"""Schemas of the engine's tables, and a check of a DataFrame against one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INTERACTIONS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("rating", T.DoubleType())])
CANDIDATES = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType())])
TRUTH = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("item_id", T.LongType())])
RAW_REVIEWS = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("parent_asin", T.StringType()), T.StructField("asin", T.StringType()), T.StructField("rating", T.DoubleType()), T.StructField("timestamp", T.LongType())])
RATINGS_CSV = T.StructType([T.StructField("userId", T.LongType()), T.StructField("movieId", T.LongType()), T.StructField("rating", T.DoubleType()), T.StructField("timestamp", T.LongType())])
CHECKPOINT = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("ndcg", T.DoubleType()), T.StructField("n_in", T.LongType()), T.StructField("n_out", T.LongType()), T.StructField("latency_s", T.DoubleType()), T.StructField("llm_order", T.ArrayType(T.IntegerType()))])


def validate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the schema's columns in its order and types; a missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
