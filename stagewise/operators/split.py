"""Temporal splits, and sequences taken from histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagewise.operators.prepare import ORDER, keep_first


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``back`` (1 is a user's last row) and ``n`` (its rows)."""
    back = W.partitionBy("user_id").orderBy(*[F.desc(c) for c in order])
    return df.withColumn("back", F.row_number().over(back)).withColumn("n", F.count("*").over(W.partitionBy("user_id")))


def leave_one_out(df: DataFrame, least: int = 3, order: list[str] | None = None) -> DataFrame:
    """Adds split: a user's last row is "test"; users with fewer than ``least`` rows are dropped (0: none are)."""
    rows = _numbered(df, order or ORDER).where(F.col("n") >= least)
    return rows.withColumn("split", F.when(F.col("back") == 1, "test").otherwise("train")).drop("back", "n")


def last_five(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Adds split: last 5 "test", the one before "val"; users with fewer than 7 rows are all "train"."""
    split = F.when(F.col("n") < 7, "train").when(F.col("back") <= 5, "test").when(F.col("back") == 6, "val").otherwise("train")
    return _numbered(df, order or ORDER).withColumn("split", split).drop("back", "n")


def last_of(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Each user's last row."""
    return _numbered(df, order or ORDER).where("back = 1").drop("back", "n")


def last_n_positives(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """Adds split: last n "test" as a set of positives; users with n + 2 rows or fewer are dropped."""
    rows = _numbered(df, order or ORDER).where(F.col("n") > n + 2)
    return rows.withColumn("split", F.when(F.col("back") <= n, "test").otherwise("train")).drop("back", "n")


def held_out_label(train: DataFrame, order: list[str] | None = None) -> DataFrame:
    """user_id and the item of its last training row."""
    return train.groupBy("user_id").agg(F.max_by("item_id", F.struct(*(order or ORDER))).alias("label_item"))


def sequence_samples(df: DataFrame, longest: int = 50, order: list[str] | None = None) -> DataFrame:
    """user_id, position, target and the previous items (at most ``longest``) of each row but the first."""
    w = W.partitionBy("user_id").orderBy(*(order or ORDER))
    rows = df.select("user_id", F.row_number().over(w).alias("position"), F.col("item_id").alias("target"), F.collect_list("item_id").over(w.rowsBetween(-longest, -1)).alias("input"))
    return rows.where("position > 1")


def left_padded(items: Column, length: int) -> Column:
    """The last ``length`` items with zeros before them."""
    zero = F.lit(0).cast("long")
    tail = F.slice(items, F.greatest(F.size(items) - length + 1, F.lit(1)), F.lit(length))
    return F.concat(F.array_repeat(zero, F.greatest(F.lit(length) - F.size(items), F.lit(0))), tail)


def history_tail(df: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """user_id, item_id, back of each user's last n rows."""
    return _numbered(df, order or ORDER).where(F.col("back") <= n).select("user_id", "item_id", "back")


def histories(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """user_id and its items in order."""
    rows = df.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*(order or ORDER)))).alias("rows"))
    return rows.select("user_id", F.transform("rows", lambda r: r["item_id"]).alias("history"))


def met_items(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """user_id and items: each user's distinct items, the last first, each where its first row stands.

    df: an interaction log. Rows are dealt by user once; firsts and order are found there.
    """
    order = order or ORDER
    rows = keep_first(df.select("user_id", *order).repartition("user_id"), order)
    rows = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(*order)), asc=False).alias("rows"))
    return rows.select("user_id", F.transform("rows", lambda r: r["item_id"]).alias("items"))


def popularity_percentile(df: DataFrame, scale: int = 99) -> DataFrame:
    """item_id, n, average-rank percentile of its count, and that on 0..scale."""
    counts = df.groupBy("item_id").agg(F.count("*").alias("n"))
    # counts of counts: as many rows as different counts, not items
    levels = counts.groupBy("n").agg(F.count("*").alias("ties"))
    below = F.coalesce(F.sum("ties").over(W.orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("ties").over(W.partitionBy())
    levels = levels.select("n", ((below + (F.col("ties") + 1) / 2) / total).alias("pct"))
    return counts.join(levels, "n").select("item_id", "n", "pct", F.round(F.col("pct") * scale).cast("long").alias("pct_scaled"))
