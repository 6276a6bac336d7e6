"""Inference on per-user metrics: bootstrap, signed ranks, multiple testing, effect sizes, power, off-policy estimates."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagewise.functions.arith import MODULUS, hash32
from stagewise.functions.lineage import cut

#: Values up to which resampling sends them to every task.
SENT_VALUES = 1 << 20


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 + F.when(z < 0, -erf).otherwise(erf))


def two_sided(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def resampled_means(values: DataFrame, column: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """draw, mean: ``draws`` resamples with replacement, each index an arithmetic hash.

    values: user_id (each once) and the column; a null value counts for no mean. Values are
    stored and numbered by user_id once, by sorted ranges; resamples meet them by that
    number, where they are made as long as the values can be sent there.
    """
    from stagewise.operators.prepare import dense_ids

    values = cut(values.select("user_id", F.col(column).alias("v")))
    n = values.count()
    ids = dense_ids(values, "user_id")
    numbered = values.join(ids, values.user_id == ids.raw_id).select(F.col("dense_id").alias("at"), "v")
    spark = values.sparkSession
    picks = spark.range(draws * n).select(F.floor(F.col("id") / n).alias("draw"), F.pmod(hash32("id", seed), F.lit(max(1, n))).alias("at"))
    return picks.join(F.broadcast(numbered) if n <= SENT_VALUES else numbered, "at").groupBy("draw").agg(F.avg("v").alias("mean"))


def bootstrap_ci(values: DataFrame, column: str, draws: int = 1000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """Percentile interval of a mean; the number of resamples is part of the answer."""
    low = (1 - level) / 2
    means = resampled_means(values, column, draws, seed)
    return means.agg(F.percentile("mean", F.lit(low)).alias("low"), F.percentile("mean", F.lit(1 - low)).alias("high"), F.count("*").alias("draws"))


def bootstrap_difference(values: DataFrame, a: str, b: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Mean paired difference, its interval, and twice the smaller tail share."""
    diffs = cut(values.select("user_id", (F.col(a) - F.col(b)).alias("d")))
    means = resampled_means(diffs, "d", draws, seed)
    tails = means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), F.avg((F.col("mean") <= 0).cast("int")).alias("below"), F.avg((F.col("mean") >= 0).cast("int")).alias("above"))
    return diffs.agg(F.avg("d").alias("diff")).join(F.broadcast(tails)).select("diff", "low", "high", F.least(F.lit(1.0), 2 * F.least("below", "above")).alias("p"))


#: Rounds of the shuffle, and fixed values of its hash: multipliers below 2^31 and a modulus that keeps products in 63 bits.
ROUNDS, MIX_ONE, MIX_TWO, KEYS = 24, 1597334677, 1597334773, 2_000_000_011
#: Values are compared as whole numbers of this part.
PART = 1_000_000_000


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x * MIX_ONE + seed) % MODULUS
    return (x ^ (x >> 15)) * MIX_TWO % MODULUS


def dealt_places(at: np.ndarray, salts: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The places that positions below ``size`` take in the permutation of these salts, one a round.

    Swap-or-not rounds: a position and its mirror about a key change places or stay together,
    by a hash of the larger one. Every round is a bijection of the positions, whatever their number.
    """
    x = at
    for salt in salts.tolist():
        mirror = (salt - x) % size
        key = (np.maximum(x, mirror) % KEYS * 3 + salt) % KEYS
        x = np.where(_mixed(key, seed) >> 31 == 1, mirror, x)
    return x


def permutation_test(values: DataFrame, a: str, b: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Pooled permutation: the values of both arms, pairs broken up, are dealt to two sides of equal size again.

    diff and p, the share of draws whose sides lie as far apart as the arms. Positions are
    permuted by a keyed bijection, so a draw needs no sort and its halves are exact; a task adds
    its values up for all draws and sends one sum a draw. Sums are of whole billionths, so
    neither ties nor the order of rows decide by rounding. values: user_id (each once), a, b;
    pairs with a null are left out; p is null without pairs.
    """
    from stagewise.operators.prepare import dense_ids

    whole = lambda c: F.round(F.col(c) * PART).cast("long")
    pairs = cut(values.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select("user_id", whole(a).alias("x"), whole(b).alias("y")))
    n = pairs.count()
    ids = dense_ids(pairs, "user_id")
    placed = pairs.join(ids, pairs.user_id == ids.raw_id).select(F.col("dense_id").cast("long").alias("at"), "x", "y")

    salts = _mixed(np.arange(draws * ROUNDS) % KEYS, seed).reshape(draws, ROUNDS)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [0] * draws
        for rows in batches:
            at = np.concatenate([2 * rows["at"].to_numpy(), 2 * rows["at"].to_numpy() + 1])
            v = np.concatenate([rows["x"].to_numpy(), rows["y"].to_numpy()])
            for d in range(draws):
                sums[d] += int(v[dealt_places(at, salts[d], 2 * n, seed) < n].sum())
        yield pd.DataFrame({"draw": range(draws), "first": [Decimal(s) for s in sums]})

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    dealt = placed.mapInPandas(deal, "draw long, first decimal(38,0)").groupBy("draw").agg(exact("first").alias("first"))
    seen = pairs.agg(exact("x").alias("sx"), exact("y").alias("sy"), F.count("*").alias("n"))
    diff = (F.col("sx") - F.col("sy")).cast("double") / PART / F.nullif("n", F.lit(0))
    far = F.abs(2 * F.col("first") - F.col("sx") - F.col("sy")) >= F.abs(F.col("sx") - F.col("sy"))
    return seen.join(F.broadcast(dealt), F.lit(True), "left").groupBy(diff.alias("diff"), "n").agg(F.avg(far.cast("int")).alias("p")).select("diff", F.when(F.col("n") > 0, F.col("p")).alias("p"))


def average_rank(order: Column, partition: list[str]) -> Column:
    """Rank in which ties share their mean."""
    ties = W.partitionBy(*partition, order)
    return F.rank().over(W.partitionBy(*partition).orderBy(order)) + (F.count("*").over(ties) - 1) / 2


def ranked_levels(values: DataFrame, column: str) -> DataFrame:
    """Each different value with its ties and average rank: windows run over levels, not rows."""
    levels = values.groupBy(column).agg(F.count("*").alias("ties"))
    below = F.coalesce(F.sum("ties").over(W.orderBy(column).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return levels.select(column, "ties", (below + (F.col("ties") + 1) / 2).alias("avg_rank"))


def wilcoxon(values: DataFrame, a: str, b: str, least: int = 5) -> DataFrame:
    """Signed-rank W, tie-corrected z and normal p; null below ``least`` nonzero differences."""
    d = values.select(F.round(F.col(a) - F.col(b), 12).alias("d")).where("d <> 0").select("d", F.abs("d").alias("size"))
    levels = ranked_levels(d, "size")
    signed = d.groupBy("size").agg(F.count(F.when(F.col("d") > 0, 1)).alias("plus")).join(levels, "size")
    s = signed.agg(F.sum(F.col("plus") * F.col("avg_rank")).alias("w_plus"), F.sum("ties").alias("n"), F.sum(F.col("ties") * F.col("ties") * F.col("ties") - F.col("ties")).alias("t"))
    n = F.col("n")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48
    s = s.select("n", "w_plus", F.least("w_plus", n * (n + 1) / 2 - F.col("w_plus")).alias("w"), ((F.col("w_plus") - mean) / F.sqrt(var)).alias("z"))
    enough = lambda c: F.when(F.col("n") >= least, c)
    return s.select(F.coalesce("n", F.lit(0)).alias("n"), enough(F.col("w")).alias("w"), enough(F.col("z")).alias("z"), enough(two_sided(F.col("z"))).alias("p"))


def paired_t(values: DataFrame, a: str, b: str) -> DataFrame:
    """Paired t and normal p; p is 1 when all differences are equal."""
    d = F.col(a) - F.col(b)
    s = values.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    t = F.col("mean") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))
    return s.select("n", "mean", t.alias("t"), F.coalesce(two_sided(t), F.lit(1.0)).alias("p"))


def spearman(values: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks."""
    ra = ranked_levels(values, a).select(a, F.col("avg_rank").alias("ra"))
    rb = ranked_levels(values, b).select(b, F.col("avg_rank").alias("rb"))
    return values.join(ra, a).join(rb, b).agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n"))


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """name, p, adjusted p, rejected: step-down, stopping at the first that isn't. tests: name, p (few rows)."""
    m = tests.agg(F.count("*").alias("m"))
    w = W.orderBy("p", "name")
    rows = tests.withColumn("at", F.row_number().over(w)).join(F.broadcast(m))
    running = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    step = (F.col("m") - F.col("at") + 1) * F.col("p")
    return rows.select("name", "p", F.least(F.lit(1.0), F.max(step).over(running)).alias("p_adjusted"), F.bool_and(F.col("p") <= F.lit(alpha) / (F.col("m") - F.col("at") + 1)).over(running).alias("rejected"))


def cohens_d(values: DataFrame, a: str, b: str) -> DataFrame:
    """Three effect sizes: pooled, paired, and against the spread of the first arm."""
    d = F.col(a) - F.col(b)
    s = values.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.stddev_samp(d).alias("sd"), F.stddev_pop(a).alias("pa"))
    diff = F.col("ma") - F.col("mb")
    over = lambda c: diff / F.nullif(c, F.lit(0.0))
    return s.select(over(F.sqrt((F.col("va") + F.col("vb")) / 2)).alias("d_pooled"), over(F.col("sd")).alias("d_paired"), over(F.col("pa")).alias("d_one_arm"))


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


#: Normal quantile of 1 - 0.05 / 2.
Z_975 = 1.959963984540054


def power_paired(effect: Column, n: Column) -> Column:
    """Power of a paired two-sided test at 5 %, by the normal approximation."""
    shift = F.abs(effect) * F.sqrt(n)
    return normal_cdf(shift - Z_975) + normal_cdf(-shift - Z_975)


def required_n(effect: Column, z_power: float = 0.8416212335729143) -> Column:
    """Pairs for power .8 at 5 %."""
    return F.ceil(((Z_975 + z_power) / F.abs(effect)) * ((Z_975 + z_power) / F.abs(effect)))


def detectable(n: Column, z_power: float = 0.8416212335729143) -> Column:
    """Smallest effect found with power .8 at 5 %."""
    return (Z_975 + z_power) / F.sqrt(n)


def ols2(values: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """Least squares of y on two variables by the normal equations: b0, b1, b2, r2; null where they are collinear."""
    c = lambda a, b: F.covar_pop(a, b)
    s = values.agg(F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), c(x1, x1).alias("v1"), c(x2, x2).alias("v2"), c(x1, x2).alias("c12"), c(x1, y).alias("c1"), c(x2, y).alias("c2"), c(y, y).alias("vy"))
    d = F.nullif(F.round(F.col("v1") * F.col("v2") - F.col("c12") * F.col("c12"), 15), F.lit(0.0))
    s = s.withColumn("b1", (F.col("c1") * F.col("v2") - F.col("c2") * F.col("c12")) / d).withColumn("b2", (F.col("c2") * F.col("v1") - F.col("c1") * F.col("c12")) / d)
    return s.select((F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"), "b1", "b2", ((F.col("b1") * F.col("c1") + F.col("b2") * F.col("c2")) / F.nullif(F.col("vy"), F.lit(0.0))).alias("r2"))


def off_policy(logs: DataFrame, clip: float = 100.0) -> DataFrame:
    """Direct mean, inverse propensity, self-normalised and doubly robust estimates.

    logs: reward, p_target, p_logging, q_hat (reward model). Weights are clipped.
    """
    w = F.least(F.col("p_target") / (F.col("p_logging") + 1e-8), F.lit(clip))
    r = F.col("reward")
    return logs.agg(F.avg("reward").alias("direct"), F.avg(w * r).alias("ips"), (F.sum(w * r) / F.nullif(F.sum(w), F.lit(0.0))).alias("snips"), F.avg(F.col("q_hat") + w * (r - F.col("q_hat"))).alias("dr"))


def auc(scores: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from the rank sum of the positives."""
    levels = ranked_levels(scores, score)
    plus = scores.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("plus")).join(levels, score)
    s = plus.agg(F.sum(F.col("plus") * F.col("avg_rank")).alias("r"), F.sum("plus").alias("p"), F.sum("ties").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return s.select(((F.col("r") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0))).alias("auc"), p.alias("positives"), q.alias("negatives"))


def score_spread(values: DataFrame, column: str) -> DataFrame:
    """Percentiles of raw scores: the spread of users, not an interval of the mean."""
    return values.agg(F.percentile(column, F.lit(0.025)).alias("p2_5"), F.percentile(column, F.lit(0.5)).alias("median"), F.percentile(column, F.lit(0.975)).alias("p97_5"))
