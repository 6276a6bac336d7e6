"""Exact tails against published tables and plain loops."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from stagewise.functions import distributions as dist


def test_normal_tail(spark):
    z = [-9.0, -3.0, -0.5, 0.0, 0.1, 1.0, 1.959963984540054, 5.0, 7.0, 7.2, 20.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(dist.normal_tail(F.col("z")).alias("p")).collect()]
    for v, p in zip(z, got, strict=True):
        assert p == pytest.approx(math.erfc(v / math.sqrt(2)) / 2, rel=1e-7, abs=1e-15)


def test_critical_values_of_the_tables(spark):
    # two-sided 5 % values of Student's t
    table = {1: 12.70620474, 2: 4.30265273, 3: 3.18244631, 5: 2.57058184, 10: 2.22813885, 30: 2.04227246, 120: 1.97993041, 10_000: 1.96020124}
    rows = spark.createDataFrame([(float(d),) for d in table], "df double").select("df", dist.t_critical(F.col("df")).alias("c"), dist.t_two_sided(dist.t_critical(F.col("df")), F.col("df")).alias("p"))
    for r in rows.collect():
        assert r.c == pytest.approx(table[int(r.df)], abs=1e-6)
        assert r.p == pytest.approx(0.05, abs=1e-9)


def test_closed_forms(spark):
    # one degree of freedom is Cauchy; two have t / sqrt(2 + t * t)
    rows = spark.createDataFrame([(t,) for t in (0.0, 0.3, 1.0, 4.0, 40.0)], "t double").select("t", dist.t_tail(F.col("t"), F.lit(1.0)).alias("one"), dist.t_tail(F.col("t"), F.lit(2.0)).alias("two"))
    for r in rows.collect():
        assert r.one == pytest.approx(0.5 - math.atan(r.t) / math.pi, abs=1e-9)
        assert r.two == pytest.approx(0.5 - r.t / math.sqrt(2 + r.t * r.t) / 2, abs=1e-9)


def _power(effect, n, critical):
    """Simpson's rule over the chi density of S, by plain loops."""
    df, shift, steps = n - 1, effect * math.sqrt(n), 20_000
    top = 3 if df > 30 else 8
    phi = lambda z: math.erfc(z / math.sqrt(2)) / 2
    log_c = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2)
    total = 0.0
    for i in range(1, steps + 1):
        s = top * i / steps
        f = math.exp(log_c + (df - 1) * math.log(s) - df * s * s / 2) * (phi(critical * s - shift) + phi(critical * s + shift))
        total += f * (1 if i == steps else 4 if i % 2 else 2)
    return total * top / steps / 3


def test_power_against_a_loop_and_cohen(spark):
    rows = [(0.5, 20), (0.126, 500), (-0.3, 80), (0.05, 10), (2.0, 4), (0.0, 30), (0.4, 1), (3.0, 4000)]
    got = spark.createDataFrame(rows, "d double, n long").select("d", "n", dist.t_critical((F.col("n") - 1).cast("double")).alias("c"), dist.power_paired(F.col("d"), F.col("n")).alias("p")).collect()
    for r in got:
        if r.n < 2:
            assert r.p is None
        elif r.d == 0:
            assert r.p == 0.05
        else:
            assert r.p == pytest.approx(_power(r.d, r.n, r.c), abs=1e-6)
    # two samples of 64 find a medium effect with .80; 34 pairs do
    one = spark.range(1).select(dist.power_two_samples(F.lit(0.5), F.lit(64)).alias("two"), dist.required_pairs(F.lit(0.5)).alias("n"), dist.required_pairs(F.lit(0.0)).alias("none"), dist.required_pairs(F.lit(1e-9)).alias("most")).first()
    assert one.two == pytest.approx(0.8015, abs=1e-4)
    assert (one.n, one.none, one.most) == (34, None, 100_000)


def test_detectable_effect_has_the_power(spark):
    rows = spark.createDataFrame([(2,), (12,), (300,)], "n long").withColumn("c", dist.t_critical((F.col("n") - 1).cast("double")))
    rows = rows.withColumn("d", dist.detectable_effect(F.col("n"), F.col("c"))).select("d", dist.power_paired(F.col("d"), F.col("n")).alias("p"))
    assert [r.p for r in rows.collect()] == pytest.approx([0.8] * 3, abs=1e-9)


def test_signed_ranks_against_all_signs(spark):
    cases = [(w, n) for n in range(1, 8) for w in range(n * (n + 1) // 4 + 1)] + [(434, 50), (3, 51)]
    got = {(r.w, r.n): r.p for r in spark.createDataFrame(cases, "w long, n long").select("w", "n", dist.signed_rank_two_sided(F.col("w"), F.col("n")).alias("p")).collect()}
    for w, n in cases[:-2]:
        below = sum(sum(s) <= w for s in itertools.product(*[(0, k) for k in range(1, n + 1)]))
        assert got[w, n] == pytest.approx(min(1.0, 2 * below / 2**n))
    assert 0.048 < got[434, 50] <= 0.05  # the published critical value of 50 pairs
    assert got[3, 51] is None
