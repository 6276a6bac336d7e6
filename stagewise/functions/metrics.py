"""Ranking metrics per user, ceilings that retrieval puts on them, and diagnostics.

ranked: user_id, rank (from 1), item_id; truth: distinct user_id, item_id. Users are those
of the truth; one without candidates scores 0.
"""

from __future__ import annotations

from itertools import accumulate
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gain(rank: Column) -> Column:
    return 1 / F.log2(rank + 1.0)


def ideal(n: Column, k: int = 10) -> Column:
    """Sum of the first min(n, k) gains."""
    sums = [0.0, *accumulate(1 / log2(j + 1) for j in range(1, k + 1))]
    return F.element_at(F.array(*map(F.lit, sums)), (F.least(n, F.lit(k)) + 1).cast("int"))


def hits(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """user_id, rank of each ranked item that is in the truth."""
    return ranked.select("user_id", "rank", "item_id").join(truth.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi").select("user_id", "rank")


def per_user(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (10, 20), window: int = 100) -> DataFrame:
    """user_id, n_truth, m (hits in the window), ndcg/recall/hit/map at each k, and mrr."""
    size = truth.groupBy("user_id").agg(F.count_distinct("item_id").alias("n_truth"))
    found = hits(ranked, truth).withColumn("nth", F.row_number().over(W.partitionBy("user_id").orderBy("rank")))
    r = F.col("rank")
    aggs = [F.count(F.when(r <= window, 1)).alias("m"), (1 / F.min("rank")).alias("mrr")]
    for k in ks:
        at = r <= k
        aggs += [F.sum(F.when(at, gain(r))).alias(f"dcg_{k}"), F.count(F.when(at, 1)).alias(f"n_{k}"), F.sum(F.when(at, F.col("nth") / r)).alias(f"prec_{k}")]
    rows = size.join(found.groupBy("user_id").agg(*aggs), "user_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [F.coalesce("m", F.lit(0)).alias("m"), zero(F.col("mrr")).alias("mrr")]
    for k in ks:
        out += [zero(F.col(f"dcg_{k}") / ideal(F.col("n_truth"), k)).alias(f"ndcg_{k}"), zero(F.col(f"n_{k}") / F.col("n_truth")).alias(f"recall_{k}"),
                (F.coalesce(F.col(f"n_{k}"), F.lit(0)) > 0).cast("int").alias(f"hit_{k}"), zero(F.col(f"prec_{k}") / F.least(F.col("n_truth"), F.lit(k))).alias(f"map_{k}")]
    return rows.select("user_id", "n_truth", *out)


def local_ndcg(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """NDCG against the best order of the hits inside the top k alone: not to be read as NDCG."""
    got = hits(ranked, truth).where(F.col("rank") <= k).groupBy("user_id").agg(F.sum(gain(F.col("rank"))).alias("dcg"), F.count("*").alias("n"))
    users = truth.select("user_id").distinct()
    return users.join(got, "user_id", "left").select("user_id", F.coalesce(F.col("dcg") / ideal(F.col("n"), k), F.lit(0.0)).alias("ndcg_local"))


def with_ceiling(users: DataFrame, k: int = 10) -> DataFrame:
    """Adds ceiling: the NDCG@k of putting the window's m hits first."""
    return users.withColumn("ceiling", ideal(F.col("m"), k) / ideal(F.col("n_truth"), k))


def ceiling_of_rate(recall: Column, n: Column, k: int = 10) -> Column:
    """The ceiling from a recall rate, by ceil(recall x n) hits; 1e-9 absorbs rounding of the product."""
    return ideal(F.ceil(recall * n - 1e-9), k) / ideal(n, k)


def regime(recall: Column) -> Column:
    return F.when(recall < 0.05, "CRITICAL").when(recall < 0.15, "WARNING").when(recall < 0.30, "MODERATE").otherwise("GOOD")


def recall_bin(recall: Column) -> Column:
    """A closed partition of [0, 1]."""
    return F.when(recall <= 0, "zero").when(recall < 0.1, "low").when(recall < 0.5, "mid").otherwise("high")


def five_bins(recall: Column) -> Column:
    return F.when(recall <= 0, "none").when(recall <= 0.1, "to_10").when(recall <= 0.5, "to_50").when(recall < 1, "below_all").otherwise("all")


def right_closed_bin(recall: Column) -> Column:
    """Right-closed edges .05, .1, .2, .5, 1 with a bin of its own for zero."""
    return F.when(recall <= 0, "0").when(recall <= 0.05, "(0,.05]").when(recall <= 0.1, "(.05,.1]").when(recall <= 0.2, "(.1,.2]").when(recall <= 0.5, "(.2,.5]").otherwise("(.5,1]")


def stratum(n: Column, edges: tuple[tuple[int, str], ...], last: str) -> Column:
    """The first label whose upper edge n doesn't exceed."""
    out = None
    for top, name in edges:
        out = F.when(n <= top, name) if out is None else out.when(n <= top, name)
    return out.otherwise(last)


#: User strata in use: upper edges and labels.
STRATA = {
    "three": (((4, "<5"), (15, "5-15")), ">15"),
    "decades": (((9, "3-9"), (49, "10-49")), "50+"),
    "five": (((2, "1-2"), (5, "3-5"), (15, "6-15"), (50, "16-50")), "51+"),
    "cold": (((5, "cold"), (20, "warm")), "hot"),
    "low": (((2, "<=2"), (10, "<=10")), ">10"),
}


def adaptive_k(scored: DataFrame, k_min: int = 50, k_max: int = 500) -> DataFrame:
    """user_id, difficulty, k_user from the concentration of the top 100 scores over ranks 101..k_max."""
    r = F.col("rank")
    g = scored.groupBy("user_id").agg(F.avg(F.when(r <= 100, F.col("score"))).alias("top"), F.avg(F.when((r > 100) & (r <= k_max), F.col("score"))).alias("rest"), F.count("*").alias("n"))
    ratio = F.when(F.coalesce("rest", F.lit(0.0)) > 0, F.col("top") / (F.col("rest") + 1e-10)).otherwise(F.lit(1.0))
    difficulty = F.round(1 / (1 + F.log1p(ratio)), 9)
    k = F.floor(k_min + difficulty * (k_max - k_min)).cast("int")
    k = F.when(F.col("n") < 100, F.lit(k_max)).otherwise(F.least(F.greatest(k, F.lit(k_min)), F.lit(k_max)))
    return g.select("user_id", difficulty.alias("difficulty"), k.alias("k_user"))


def adaptive_k_by_spread(scored: DataFrame, low: int = 100, high: int = 300) -> DataFrame:
    """The other formula: difficulty 1 - min(5 x standard deviation of the scores, 1), .8 without any."""
    g = scored.groupBy("user_id").agg(F.stddev_pop("score").alias("sd"))
    difficulty = F.coalesce(1 - F.least(5 * F.col("sd"), F.lit(1.0)), F.lit(0.8))
    return g.select("user_id", F.round(difficulty, 9).alias("difficulty"), F.floor(low + F.round(difficulty, 9) * (high - low)).cast("int").alias("k_user"))


def kendall_tau(orders: DataFrame) -> DataFrame:
    """user_id and (concordant - discordant) / pairs between original place and new place.

    orders: user_id, place, new_place.
    """
    a = orders.select("user_id", F.col("place").alias("pa"), F.col("new_place").alias("na"))
    b = orders.select("user_id", F.col("place").alias("pb"), F.col("new_place").alias("nb"))
    pairs = a.join(b, "user_id").where("pa < pb")
    return pairs.groupBy("user_id").agg((F.sum(F.signum(F.col("nb") - F.col("na"))) / F.count("*")).alias("tau"))
