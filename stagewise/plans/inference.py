"""Intervals, tests, effect sizes and off-policy estimates on per-user metrics."""

from __future__ import annotations

from stagewise.functions import distributions, stats
from stagewise.plans.base import F, Frames, hash_sql, query, rounded

_N = "(SELECT count(*) FROM two_arms)"


def _means(value: str, draws: int = 1000) -> str:
    return f"SELECT i // {_N} AS draw, avg({value}) AS mean FROM (SELECT i, {hash_sql('i', 7)} % {_N} AS pl FROM range(0, {draws} * {_N}) r(i)) JOIN (SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS pl FROM two_arms) USING (pl) GROUP BY 1"


@query("bootstrap_hash_ci", f"SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, count(*) AS draws FROM ({_means('a')})")
def _(f: Frames):
    return rounded(stats.bootstrap_ci(f.two_arms, "a"))


@query("bootstrap_diff", f"SELECT round((SELECT avg(a - b) FROM two_arms), 6) AS diff, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, round(least(1.0, 2 * least(avg(CASE WHEN mean <= 0 THEN 1 ELSE 0 END), avg(CASE WHEN mean >= 0 THEN 1 ELSE 0 END))), 6) AS p FROM ({_means('a - b')})")
def _(f: Frames):
    return rounded(stats.bootstrap_difference(f.two_arms, "a", "b"))


def _mixed(x: str) -> str:
    first = f"(({x}) * {stats.MIX_ONE} + 7) % {stats.MODULUS}"
    return f"(xor({first}, ({first}) >> 15) * {stats.MIX_TWO} % {stats.MODULUS})"


#: A position's place after the shuffle of a draw: d, the draw's salts in order, and 2 n positions.
_DEALT = f"list_reduce(list_prepend(pl, salts), lambda x, salt: CASE WHEN {_mixed(f'(greatest(x, (salt - x % m + m * 4294967296) % m) % {stats.KEYS} * 3 + salt) % {stats.KEYS}')} >> 31 = 1 THEN (salt - x + m * 4294967296) % m ELSE x END)"


@query("permutation_test", f"""
SELECT * FROM (WITH p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY user_id) - 1 AS i, CAST(round(a * 1000000000) AS BIGINT) AS x, CAST(round(b * 1000000000) AS BIGINT) AS y FROM two_arms),
v AS (SELECT 2 * i AS pl, x AS v FROM p UNION ALL SELECT 2 * i + 1, y FROM p),
s AS (SELECT g, list_transform(range(0, {stats.ROUNDS}), lambda r: {_mixed(f'g * {stats.ROUNDS} + r')}) AS salts FROM range(0, 1000) r(g)),
t AS (SELECT sum(x) AS sx, sum(y) AS sy, avg((x - y) / 1000000000) AS d, 2 * count(*) AS m FROM p)
SELECT round(any_value(d), 6) AS diff, round(avg(CASE WHEN abs(2 * first - sx - sy) >= abs(sx - sy) THEN 1 ELSE 0 END), 6) AS p FROM (
 SELECT g, sum(v) FILTER (place < m // 2) AS first FROM (SELECT g, v, m, {_DEALT} AS place FROM v, s, (SELECT CAST(m AS BIGINT) AS m FROM t)) GROUP BY g), t)""")
def _(f: Frames):
    return rounded(stats.permutation_test(f.two_arms, "a", "b"))


def _phi(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    e = f"(1 - {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{x} * {x}))"
    return f"(0.5 * (1 + CASE WHEN {z} < 0 THEN -{e} ELSE {e} END))"


_SIGNED = "SELECT d, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r, count(*) OVER (PARTITION BY s) AS t FROM (SELECT round(a - b, 12) AS d, abs(round(a - b, 12)) AS s FROM two_arms) WHERE d <> 0"


@query("wilcoxon_z", f"""
SELECT n, round(least(w, n * (n + 1) / 2 - w), 6) AS w, round(z, 6) AS z, round(2 * (1 - {_phi('abs(z)')}), 6) AS p FROM (
 SELECT n, w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48) AS z FROM (
  SELECT count(*) AS n, sum(r) FILTER (d > 0) AS w, sum(t * t - 1) AS t FROM ({_SIGNED})))""")
def _(f: Frames):
    return rounded(stats.wilcoxon(f.two_arms, "a", "b"))


@query("paired_t", f"SELECT n, round(mean, 6) AS mean, round(t, 6) AS t, round(coalesce(2 * (1 - {_phi('abs(t)')}), 1.0), 6) AS p FROM (SELECT count(*) AS n, avg(a - b) AS mean, avg(a - b) / nullif(stddev_samp(a - b) / sqrt(count(*)), 0) AS t FROM two_arms)")
def _(f: Frames):
    return rounded(stats.paired_t(f.two_arms, "a", "b"))


@query("spearman", "SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY n_hist) + (count(*) OVER (PARTITION BY n_hist) - 1) / 2 AS ra, rank() OVER (ORDER BY round(a, 9)) + (count(*) OVER (PARTITION BY round(a, 9)) - 1) / 2 AS rb FROM two_arms)")
def _(f: Frames):
    return rounded(stats.spearman(f.two_arms.select("n_hist", F.round("a", 9).alias("a")), "n_hist", "a"))


_TESTS = f"SELECT 'group ' || g AS name, round(2 * (1 - {_phi('abs(t)')}), 9) AS p FROM (SELECT user_id % 6 AS g, coalesce(avg(a - b) / nullif(stddev_samp(a - b) / sqrt(count(*)), 0), 0) AS t FROM two_arms GROUP BY 1)"


@query("holm", f"SELECT name, round(p, 6) AS p, round(least(1.0, max((m - pl + 1) * p) OVER w), 6) AS p_adjusted, bool_and(p <= 0.05 / (m - pl + 1)) OVER w AS rejected FROM (SELECT *, row_number() OVER (ORDER BY p, name) AS pl, count(*) OVER () AS m FROM ({_TESTS})) WINDOW w AS (ORDER BY p, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(f: Frames):
    d = F.col("a") - F.col("b")
    g = f.two_arms.groupBy((F.col("user_id") % 6).alias("g")).agg(F.coalesce(F.avg(d) / F.nullif(F.stddev_samp(d) / F.sqrt(F.count("*")), F.lit(0.0)), F.lit(0.0)).alias("t"))
    return rounded(stats.holm(g.select(F.concat(F.lit("group "), F.col("g").cast("string")).alias("name"), F.round(stats.two_sided(F.col("t")), 9).alias("p"))))


@query("cohens_d", "SELECT round((avg(a) - avg(b)) / nullif(sqrt((var_samp(a) + var_samp(b)) / 2), 0), 6) AS d_pooled, round((avg(a) - avg(b)) / nullif(stddev_samp(a - b), 0), 6) AS d_paired, round((avg(a) - avg(b)) / nullif(stddev_pop(a), 0), 6) AS d_one_arm FROM two_arms")
def _(f: Frames):
    return rounded(stats.cohens_d(f.two_arms, "a", "b"))


@query("effect_labels", "SELECT g, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS label FROM (SELECT user_id % 9 AS g, round(coalesce(avg(a - b) / nullif(stddev_samp(a - b), 0), 0), 9) AS d FROM two_arms GROUP BY 1)")
def _(f: Frames):
    d = F.col("a") - F.col("b")
    g = f.two_arms.groupBy((F.col("user_id") % 9).alias("g")).agg(F.round(F.coalesce(F.avg(d) / F.nullif(F.stddev_samp(d), F.lit(0.0)), F.lit(0.0)), 9).alias("d"))
    return rounded(g.select("g", "d", stats.effect_label(F.col("d")).alias("label")))


_Z = "1.959963984540054"
_GROUPS = "SELECT user_id % 9 AS g, count(*) AS n, round(coalesce(avg(a - b) / nullif(stddev_samp(a - b), 0), 0), 9) AS d, coalesce(avg(a - b) / nullif(stddev_samp(a - b) / sqrt(count(*)), 0), 0) AS t FROM two_arms GROUP BY 1 HAVING count(*) > 1"


@query("power_normal", f"SELECT g, n, round(effect, 6) AS effect, round({_phi(f'(effect * sqrt(n) - {_Z})')} + {_phi(f'(-effect * sqrt(n) - {_Z})')}, 6) AS power, CAST(ceil((({_Z} + 0.8416212335729143) / effect) * (({_Z} + 0.8416212335729143) / effect)) AS BIGINT) AS required, round(({_Z} + 0.8416212335729143) / sqrt(n), 6) AS detectable FROM (SELECT g, n, d AS effect FROM ({_GROUPS}) WHERE d <> 0)")
def _(f: Frames):
    rows = _groups(f).where("d <> 0")
    return rounded(rows.select("g", "n", F.col("d").alias("effect"), stats.power_paired(F.col("d"), F.col("n")).alias("power"), stats.required_n(F.col("d")).cast("long").alias("required"), stats.detectable(F.col("n")).alias("detectable")))



def _tail(z: str) -> str:
    """Upper normal tail of an expression of few characters."""
    top, bottom = (" * {x} + ".join([("(" * (len(c) - 2)) + str(c[0]), *[str(v) + ")" for v in c[1:-1]], str(c[-1])]) for c in (distributions.TAIL_TOP, distributions.TAIL_BOTTOM))
    x = f"abs({z})"
    fraction = f"({x} + 0.65)"
    for k in (4, 3, 2, 1):
        fraction = f"({x} + {k} / {fraction})"
    upper = f"exp(-{x} * {x} / 2) * CASE WHEN {x} < {distributions.FAR} THEN ({top.replace('{x}', x)}) / ({bottom.replace('{x}', x)}) ELSE 1 / ({fraction} * {distributions.ROOT}) END"
    return f"(CASE WHEN {z} >= 0 THEN {upper} ELSE 1 - {upper} END)"


def _over_s(df: str, of: str) -> str:
    """Mean of an expression of s over the grid of the operator."""
    low, high = f"-(32 / {df} + 8 / sqrt(2 * {df}))", f"8 / sqrt(2 * {df})"
    grid = f"list_transform(range(0, {distributions.POINTS + 1}), lambda j: {low} + ({high} - ({low})) * j / {distributions.POINTS})"
    weight = f"exp({df} * u - {df} * (exp(2 * u) - 1) / 2)"
    return f"(list_sum(list_transform({grid}, lambda u: {weight} * {of.replace('$s', 'exp(u)')})) / list_sum(list_transform({grid}, lambda u: {weight})))"


_CRITICAL = f"list_reduce(list_prepend({_Z}::DOUBLE, list_transform(range(0, {distributions.NEWTON}), lambda j: 0::DOUBLE)), lambda t, k: t + ({_over_s('df', _tail('(t * $s)'))} - 0.025) / {_over_s('df', f'$s * exp(-t * t * $s * $s / 2) / {distributions.ROOT}')})"


@query("power_exact", f"""
SELECT g, n, round(d, 6) AS d, round(c, 6) AS critical, round(2 * {_over_s('df', _tail('(abs(t) * $s)'))}, 6) AS p,
 round(CASE WHEN d = 0 THEN 0.05 ELSE {_over_s('df', f"({_tail('(c * $s - shift)')} + {_tail('(c * $s + shift)')})")} END, 6) AS power
FROM (SELECT *, d * sqrt(n) AS shift, {_CRITICAL} AS c FROM (SELECT *, CAST(n - 1 AS DOUBLE) AS df FROM ({_GROUPS})))""")
def _(f: Frames):
    rows, df = _groups(f), (F.col("n") - 1).cast("double")
    return rounded(rows.select("g", "n", "d", distributions.t_critical(df).alias("critical"), distributions.t_two_sided(F.col("t"), df).alias("p"), distributions.power_paired(F.col("d"), F.col("n")).alias("power")))


@query("power_plan")
def _(f: Frames):
    """Pairs that each group's effect needs, and the effect that its pairs would find. SQL would nest three searches."""
    rows = _groups(f).withColumn("critical", distributions.t_critical((F.col("n") - 1).cast("double")))
    return rounded(rows.select("g", "n", "d", distributions.required_pairs(F.col("d")).alias("required"), distributions.detectable_effect(F.col("n"), F.col("critical")).alias("detectable")))


def _groups(f: Frames):
    d = F.col("a") - F.col("b")
    spread = F.nullif(F.stddev_samp(d), F.lit(0.0))
    g = f.two_arms.groupBy((F.col("user_id") % 9).alias("g")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(d) / spread, F.lit(0.0)), 9).alias("d"), F.coalesce(F.avg(d) / (spread / F.sqrt(F.count("*"))), F.lit(0.0)).alias("t"))
    return g.where("n > 1")


_OLS = "SELECT a AS y, CAST(n_hist AS DOUBLE) AS x1, b AS x2 FROM two_arms"


@query("ols_two_variables", f"""
SELECT round(my - b1 * m1 - b2 * m2, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2, round((b1 * c1 + b2 * c2) / vy, 6) AS r2 FROM (
 SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM (
  SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, var_pop(y) AS vy FROM ({_OLS})))""")
def _(f: Frames):
    return rounded(stats.ols2(f.two_arms.withColumn("n_hist", F.col("n_hist").cast("double")), "a", "n_hist", "b"))


_LOGS = "SELECT CAST(event_type = 'purchase' AS INTEGER) AS reward, (event_id % 7 + 1) / 8.0 AS pt, (event_id % 5 + 1) / 6.0 AS pl, (event_id % 3) / 4.0 AS q FROM events"


@query("ips_snips_dr", f"SELECT round(avg(reward), 6) AS direct, round(avg(w * reward), 6) AS ips, round(sum(w * reward) / nullif(sum(w), 0), 6) AS snips, round(avg(q + w * (reward - q)), 6) AS dr FROM (SELECT *, least(pt / (pl + 1e-8), 100.0) AS w FROM ({_LOGS}))")
def _(f: Frames):
    e = F.col("event_id")
    logs = f.table("events").select((F.col("event_type") == "purchase").cast("int").alias("reward"), ((e % 7 + 1) / 8).alias("p_target"), ((e % 5 + 1) / 6).alias("p_logging"), (e % 3 / 4).alias("q_hat"))
    return rounded(stats.off_policy(logs))


@query("auc_ranksum", "SELECT round((sum(r) FILTER (y = 1) - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc, p AS positives, n - p AS negatives FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r, CAST(sum(y) OVER () AS BIGINT) AS p, count(*) OVER () AS n FROM (SELECT round(value, 1) AS s, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events)) GROUP BY p, n")
def _(f: Frames):
    rows = f.table("events").select(F.round("value", 1).alias("s"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return rounded(stats.auc(rows, "s", "y"))


@query("accuracy", "SELECT round(avg(CASE WHEN (value > 50) = (event_type = 'purchase') THEN 1 ELSE 0 END), 6) AS accuracy FROM events")
def _(f: Frames):
    return rounded(f.table("events").agg(F.avg(((F.col("value") > 50) == (F.col("event_type") == "purchase")).cast("int")).alias("accuracy")))


@query("score_spread", "SELECT round(quantile_cont(recall_20, 0.025), 6) AS p2_5, round(quantile_cont(recall_20, 0.5), 6) AS median, round(quantile_cont(recall_20, 0.975), 6) AS p97_5 FROM mu")
def _(f: Frames):
    return rounded(stats.score_spread(f.mu, "recall_20"))


