"""Exact tails as columns: normal, central and non-central t, power, sample sizes, signed ranks.

A t variable is (Z + shift) / S with S**2 a chi-square over its degrees of freedom. So every
tail is the mean of a normal tail over S. With S = exp(u) the density falls exponentially on
both sides and is analytic in a strip, where the trapezoid rule is exact to about 1e-12 from
some 250 points on; dividing by the sum of the densities spares their constant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of the trapezoid rule, Newton steps of a quantile, halvings of an effect.
POINTS, NEWTON, HALVINGS = 256, 12, 44

#: The rational approximation of the normal tail by Hart, in the arrangement of West (2005).
TAIL_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: Where the continued fraction takes over, and the square root of two pi.
FAR, ROOT = 7.07106781186547, 2.506628274631


def _polynomial(x: Column, factors: tuple[float, ...]) -> Column:
    value = F.lit(factors[0])
    for c in factors[1:]:
        value = value * x + c
    return value


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def normal_tail(z: Column) -> Column:
    """P(Z > z), to 15 digits near zero and relatively in the tail."""

    def upper(x: Column) -> Column:
        fraction = x + 0.65
        for k in (4, 3, 2, 1):
            fraction = x + k / fraction
        return F.exp(-x * x / 2) * F.when(x < FAR, _polynomial(x, TAIL_TOP) / _polynomial(x, TAIL_BOTTOM)).otherwise(1 / (fraction * ROOT))

    return _let(z, lambda v: _let(_let(F.abs(v), upper), lambda p: F.when(v >= 0, p).otherwise(1 - p)))


def _mean_over_s(df: Column, of: Callable[[Column], Column]) -> Column:
    """Mean of a function of S, the root of a chi-square over its degrees of freedom; null without any."""
    df = F.when(df > 0, df)
    low, high = -(32 / df + 8 / F.sqrt(2 * df)), 8 / F.sqrt(2 * df)
    step = F.struct(df.alias("df"), low.alias("low"), ((high - low) / POINTS).alias("wide"))

    def add(sums: Column, g: Column, k: Column) -> Column:
        u = lambda of_u: _let(g["low"] + g["wide"] * k, of_u)
        weighed = u(lambda v: _let(F.exp(v), lambda s: F.struct(s.alias("s"), F.exp(g["df"] * (v - (s * s - 1) / 2)).alias("w"))))
        return _let(weighed, lambda x: F.struct((sums["top"] + x["w"] * of(x["s"])).alias("top"), (sums["bottom"] + x["w"]).alias("bottom")))

    none = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom"))
    grid = F.sequence(F.lit(0), F.lit(POINTS))
    return _let(step, lambda g: F.aggregate(grid, none, lambda sums, k: add(sums, g, k), lambda sums: sums["top"] / sums["bottom"]))


def t_tail(t: Column, df: Column, shift: Column | None = None) -> Column:
    """P(T > t) of Student's t, or of the non-central one."""
    shift = F.lit(0.0) if shift is None else shift
    return _mean_over_s(df, lambda s: normal_tail(t * s - shift))


def t_two_sided(t: Column, df: Column) -> Column:
    return 2 * t_tail(F.abs(t), df)


def t_critical(df: Column, alpha: float = 0.05, z: float = 1.959963984540054) -> Column:
    """t that |T| exceeds with probability ``alpha``; ``z``: the same of a normal variable.

    Newton's steps rise from below, since the distribution is concave there.
    """

    def step(t: Column, _: Column) -> Column:
        density = _mean_over_s(df, lambda s: s * F.exp(-t * t * s * s / 2) / ROOT)
        return t + (t_tail(t, df) - alpha / 2) / density

    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), F.lit(z), step)


def _power(shift: Column, df: Column, critical: Column) -> Column:
    return _mean_over_s(df, lambda s: normal_tail(critical * s - shift) + normal_tail(critical * s + shift))


def _tested(shift: Column, df: Column, alpha: float, z: float) -> Column:
    return _let(df, lambda d: _let(t_critical(d, alpha, z), lambda c: _let(shift, lambda m: _power(m, d, c))))


def power_paired(effect: Column, n: Column, alpha: float = 0.05, z: float = 1.959963984540054) -> Column:
    """Power of a two-sided paired t test with ``n`` pairs: the level without an effect, null below two pairs."""
    return F.when(n >= 2, F.when(effect == 0, F.lit(alpha)).otherwise(_tested(effect * F.sqrt(n), (n - 1).cast("double"), alpha, z)))


def power_two_samples(effect: Column, n: Column, alpha: float = 0.05, z: float = 1.959963984540054) -> Column:
    """Power of a two-sided t test of two samples of ``n`` each."""
    return F.when(n >= 2, F.when(effect == 0, F.lit(alpha)).otherwise(_tested(effect * F.sqrt(n / 2), (2 * n - 2).cast("double"), alpha, z)))


def required_pairs(effect: Column, power: float = 0.8, most: int = 100_000) -> Column:
    """Fewest pairs (of 2 to ``most``) that reach the power; ``most`` if none does, null without an effect."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("long")
        enough = lambda m: F.when(power_paired(effect, m) < power, F.struct((m + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), m.alias("high")))
        return F.when(s["low"] >= s["high"], s).otherwise(_let(middle, enough))

    start = F.struct(F.lit(2).cast("long").alias("low"), F.lit(most).cast("long").alias("high"))
    return F.when(effect != 0, F.aggregate(F.sequence(F.lit(1), F.lit(most.bit_length())), start, halve, lambda s: s["low"]))


def detectable_effect(n: Column, critical: Column, power: float = 0.8) -> Column:
    """Smallest paired effect found with that power among ``n`` pairs; ``critical``: t_critical of n - 1."""
    df = (n - 1).cast("double")

    def halve(s: Column, _: Column) -> Column:
        enough = lambda m: F.when(_power(m, df, critical) < power, F.struct(m.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), m.alias("high")))
        return _let((s["low"] + s["high"]) / 2, enough)

    start = F.struct(F.lit(0.0).alias("low"), (critical + 40).alias("high"))
    return F.when(n >= 2, F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: s["high"]) / F.sqrt(n))


def signed_rank_two_sided(w: Column, n: Column, most: int = 50) -> Column:
    """Exact p of the signed-rank statistic ``w`` (the smaller sum) of ``n`` untied differences; null above ``most`` of them.

    The chance of every rank sum, one rank after the other: each falls to either side with one half.
    """
    sums = F.transform(F.sequence(F.lit(0), F.floor(n * (n + 1) / 2).cast("int")), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    add = lambda chances, k: F.transform(chances, lambda c, i: (c + F.coalesce(F.get(chances, i - k), F.lit(0.0))) / 2)
    chances = F.aggregate(F.sequence(F.lit(1), n.cast("int")), sums, add)
    below = F.aggregate(F.slice(chances, 1, F.floor(w).cast("int") + 1), F.lit(0.0), lambda s, c: s + c)
    return F.when((n >= 1) & (n <= most), F.least(F.lit(1.0), 2 * below))
