"""From an interaction log to a training frame: filters, first-of-pair, cores, subsamples, ids, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagewise.functions.arith import hash32, pair_hash32
from stagewise.functions.lineage import cut

#: Columns that order a user's rows totally.
ORDER = ["ts", "k1", "k2", "item_id", "k3"]


def interactions(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """user_id, item_id, ts, rating and the keys that break ties of ts."""
    return orders.join(lineitem, orders.o_orderkey == lineitem.l_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("o_orderdate").alias("ts"), F.col("l_quantity").cast("double").alias("rating"),
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_suppkey").alias("k3"),
    )


def implicit(df: DataFrame, least: float = 4.0) -> DataFrame:
    """Rows rated ``least`` or more."""
    return df.where(F.col("rating") >= least)


def keep_first(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The first row of each (user, item) in a total order."""
    w = W.partitionBy("user_id", "item_id").orderBy(*(order or ORDER))
    return df.withColumn("stagewise_nth", F.row_number().over(w)).where("stagewise_nth = 1").drop("stagewise_nth")


def _at_least(df: DataFrame, key: str, least: int) -> DataFrame:
    return df.groupBy(key).count().where(F.col("count") >= least).select(key)


def core(df: DataFrame, users: int = 5, items: int | None = None, rounds: int | None = None, alternating: bool = False) -> DataFrame:
    """Drop users and items with too few rows, again and again.

    Both counts are taken on the same rows, unless ``alternating``: then items are counted
    after the users' filter. Without ``rounds`` it goes on until nothing is dropped. Each
    round is written to the checkpoint folder: a round reads its rows three times, so an
    uncut plan would triple with every round.
    """
    items = users if items is None else items
    if rounds is not None:
        for _ in range(rounds):
            after = df.join(_at_least(df, "user_id", users), "user_id", "left_semi")
            df = cut(after.join(_at_least(after if alternating else df, "item_id", items), "item_id", "left_semi"))
        return df
    df = cut(df)
    n = df.count()
    while True:
        after = df.join(_at_least(df, "user_id", users), "user_id", "left_semi")
        df = cut(after.join(_at_least(after if alternating else df, "item_id", items), "item_id", "left_semi"))
        left = df.count()
        if left == n:
            return df
        n = left


def with_metadata(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows whose item has metadata."""
    return df.join(meta.select("item_id"), "item_id", "left_semi")


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """raw_id and its number from 0 in sorted order.

    Numbers are counted per sorted range and moved by the sizes of the ranges before, so
    no single task numbers all ids.
    """
    ids = df.select(F.col(key).alias("raw_id")).where(f"{key} is not null").distinct()
    ranged = ids.repartitionByRange("raw_id").withColumn("part", F.spark_partition_id())
    ranged = cut(ranged.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy("raw_id"))))
    sizes = ranged.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(before), "part").select("raw_id", (F.col("at") - 1 + F.col("before")).cast("long").alias("dense_id"))


def activity(df: DataFrame, key: str = "user_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def top_users(df: DataFrame, n: int) -> DataFrame:
    """Rows of the n users with most rows (ties: smaller id)."""
    return df.join(activity(df).orderBy(F.desc("n"), "user_id").limit(n).select("user_id"), "user_id", "left_semi")


def active_and_drawn_users(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Rows of n users: half the most active, half drawn by hash from the rest."""
    counts = activity(df)
    active = counts.orderBy(F.desc("n"), "user_id").limit(n // 2).select("user_id")
    rest = counts.join(active, "user_id", "left_anti").orderBy(hash32("user_id", seed), "user_id").limit(n - n // 2).select("user_id")
    return df.join(active.union(rest), "user_id", "left_semi")


def popular_catalog(train: DataFrame, test: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Both frames on the n most popular training items; test users without training rows go."""
    items = activity(train, "item_id").orderBy(F.desc("n"), "item_id").limit(n).select("item_id")
    train = train.join(items, "item_id", "left_semi")
    return train, test.join(items, "item_id", "left_semi").join(train.select("user_id"), "user_id", "left_semi")


def keep_share(df: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Rows whose pair hash falls below the share."""
    return df.where(pair_hash32("user_id", "item_id", seed) < F.lit(int(share * 2**32)))


def eligible(history: DataFrame, truth: DataFrame, least: int = 3) -> DataFrame:
    """Users with truth and at least ``least`` history rows: user_id, n_history, n_truth."""
    n_truth = truth.groupBy("user_id").agg(F.count_distinct("item_id").alias("n_truth"))
    return activity(history).where(F.col("n") >= least).join(n_truth, "user_id").select("user_id", F.col("n").alias("n_history"), "n_truth")


def draw_users(users: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n users without replacement, by hash order."""
    return users.orderBy(hash32("user_id", seed), "user_id").limit(n)


def disjoint_pools(history: DataFrame, truth: DataFrame, n_eval: int, n_train: int, seed: int = 42) -> DataFrame:
    """user_id and pool ("eval", "train"); training users aren't evaluated and have 4 rows or more."""
    able = eligible(history, truth)
    drawn = draw_users(able, n_eval, seed).select("user_id")
    rest = able.where("n_history >= 4").join(drawn, "user_id", "left_anti")
    train = draw_users(rest, n_train, seed + 1).select("user_id")
    return drawn.withColumn("pool", F.lit("eval")).unionByName(train.withColumn("pool", F.lit("train")))


def half_split(users: DataFrame, least: int = 50, seed: int = 42) -> DataFrame:
    """user_id and half: the first max(least, n div 2) of the hash order are "a". Users are numbered by sorted ranges."""
    n = users.agg(F.count("*").alias("total"))
    ranked = dense_ids(users.select(F.struct(hash32("user_id", seed).alias("h"), "user_id").alias("key")), "key").join(F.broadcast(n))
    return ranked.select(F.col("raw_id.user_id").alias("user_id"), F.when(F.col("dense_id") < F.greatest(F.lit(least), F.floor(F.col("total") / 2)), "a").otherwise("b").alias("half"))


def first_half(users: DataFrame, least: int = 50, seed: int = 42) -> DataFrame:
    """One row, last: the largest (hash, user_id) of half "a" as ``half_split`` deals, for comparing in place of a join."""
    n = users.agg(F.count("*").alias("total"))
    ranked = dense_ids(users.select(F.struct(hash32("user_id", seed).alias("h"), F.col("user_id").alias("user_id")).alias("key")), "key").join(F.broadcast(n))
    return ranked.where(F.col("dense_id") < F.greatest(F.lit(least), F.floor(F.col("total") / 2))).agg(F.max("raw_id").alias("last"))


def catalog_side(train: DataFrame, truth: DataFrame) -> DataFrame:
    """truth rows with "closed" (item in the training catalog) or "open"."""
    known = train.select("item_id").distinct().withColumn("side", F.lit("closed"))
    return truth.join(known, "item_id", "left").select("user_id", "item_id", F.coalesce("side", F.lit("open")).alias("side"))


def all_null(df: DataFrame, column: str) -> DataFrame:
    """The null control: whether a column is null on every row."""
    return df.agg(F.bool_and(F.col(column).isNull()).alias("all_null"), F.count("*").alias("n_rows"))


def text_of(text: Column, title: Column, item: Column) -> Column:
    """Text, or title, or "Item <id>", passing over nulls and blanks."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(text), blank(title), F.concat(F.lit("Item "), item.cast("string")))


def dataset_stats(train: DataFrame, test: DataFrame) -> DataFrame:
    """Counts and both densities: the training fraction, and the percentage over all splits."""
    both = train.select("user_id", "item_id").unionByName(test.select("user_id", "item_id"))
    t = train.agg(F.count("*").alias("n_train"), F.count_distinct("user_id").alias("users_train"), F.count_distinct("item_id").alias("items_train"))
    a = both.agg(F.count("*").alias("n_all"), F.count_distinct("user_id").alias("users_all"), F.count_distinct("item_id").alias("items_all"))
    per_user = F.col("n_all") / F.nullif(F.col("users_all"), F.lit(0))
    return t.join(F.broadcast(a)).select(
        "*", (F.col("n_train") / (F.col("users_train") * F.col("items_train"))).alias("density"),
        (per_user / F.col("items_train") * 100).alias("density_pct"), per_user.alias("per_user"), (F.col("items_all") - F.col("items_train")).alias("open_items"),
    )
