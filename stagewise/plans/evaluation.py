"""Metrics, ceilings, strata, sweeps and the flagship report."""

from __future__ import annotations

from stagewise.functions import metrics
from stagewise.functions import parse as replies
from stagewise.functions.lineage import kept
from stagewise.operators import prepare, rerank, retrieve
from stagewise.plans.base import F, Frames, _metrics, _popularity, pair_hash_sql, query, rounded

_MU = "n_truth, m, round(mrr, 6) AS mrr, " + ", ".join(f"round({x}_{k}, 6) AS {x}_{k}, " .rstrip(", ") for k in (10, 20) for x in ("ndcg", "recall", "map")) + ", hit_10, hit_20"


@query("metrics_multi_k", f"SELECT user_id, {_MU} FROM mu")
def _(f: Frames):
    return rounded(f.mu)


_CEIL = "(SELECT v FROM idcg WHERE k = 10 AND idcg.n = least(mu.{}, 10))"
CEILING = f"SELECT *, {_CEIL.format('m')} / {_CEIL.format('n_truth')} AS ceiling, m / n_truth AS recall_100 FROM mu"


def ceilings(f: Frames):
    return metrics.with_ceiling(f.mu).withColumn("recall_100", F.col("m") / F.col("n_truth"))


_REGIME = "CASE WHEN {0} < 0.05 THEN 'CRITICAL' WHEN {0} < 0.15 THEN 'WARNING' WHEN {0} < 0.30 THEN 'MODERATE' ELSE 'GOOD' END"


@query("flagship_popularity_report", f"""
SELECT users, round(recall_100, 6) AS recall_100, round(ndcg_10, 6) AS ndcg_10, round(hit_10, 6) AS hit_10, round(map_10, 6) AS map_10, round(mrr, 6) AS mrr, round(ceiling, 6) AS ceiling, round(ndcg_10 / nullif(ceiling, 0), 6) AS utilisation, {_REGIME.format('recall_100')} AS regime
FROM (SELECT count(*) AS users, avg(m / n_truth) AS recall_100, avg(ndcg_10) AS ndcg_10, avg(hit_10) AS hit_10, avg(map_10) AS map_10, avg(mrr) AS mrr, avg({_CEIL.format('m').replace('mu.', 'lu.')} / {_CEIL.format('n_truth').replace('mu.', 'lu.')}) AS ceiling FROM ({_metrics('cand', 'truth', (10,))}) lu)""")
def flagship(f: Frames):
    users = metrics.with_ceiling(metrics.per_user(f.cand, f.truth, ks=(10,)))
    means = users.agg(F.count("*").alias("users"), F.avg(F.col("m") / F.col("n_truth")).alias("recall_100"), *[F.avg(c).alias(c) for c in ("ndcg_10", "hit_10", "map_10", "mrr", "ceiling")])
    return rounded(means.select("*", (F.col("ndcg_10") / F.nullif(F.col("ceiling"), F.lit(0.0))).alias("utilisation"), metrics.regime(F.col("recall_100")).alias("regime")))


@query("ndcg_local", "SELECT s.user_id, round(coalesce(sum(1 / log2(h.rank + 1)) / any_value((SELECT v FROM idcg WHERE k = 10 AND idcg.n = h.c)), 0), 6) AS ndcg_local FROM (SELECT DISTINCT user_id FROM mtruth) s LEFT JOIN (SELECT c.user_id, c.rank, count(*) OVER (PARTITION BY c.user_id) AS c FROM mcand c JOIN mtruth t USING (user_id, item_id) WHERE c.rank <= 10) h USING (user_id) GROUP BY s.user_id")
def _(f: Frames):
    return rounded(metrics.local_ndcg(f.mcand, f.mtruth))


@query("map_mrr", "SELECT user_id, round(map_10, 6) AS map_10, round(mrr, 6) AS mrr FROM mu")
def _(f: Frames):
    return rounded(f.mu.select("user_id", "map_10", "mrr"))


@query("ceiling_cor3", f"SELECT user_id, m, n_truth, round(ceiling, 6) AS ceiling FROM ({CEILING})")
def _(f: Frames):
    return rounded(ceilings(f).select("user_id", "m", "n_truth", "ceiling"))


@query("ceiling_rate", f"SELECT user_id, round(ceiling, 6) AS ceiling FROM ({CEILING})")
def _(f: Frames):
    return rounded(ceilings(f).select("user_id", metrics.ceiling_of_rate(F.col("recall_100"), F.col("n_truth")).alias("ceiling")))


@query("eta_by_window", f"""
SELECT win, round(avg(ndcg_10), 6) AS ndcg, round(avg(c), 6) AS ceiling, round(avg(ndcg_10) / nullif(avg(c), 0), 6) AS eta
FROM (SELECT w.win, mu.ndcg_10, (SELECT v FROM idcg WHERE k = 10 AND idcg.n = least(count(h.rank) FILTER (h.rank <= w.win), 10)) / {_CEIL.format('n_truth')} AS c FROM mu CROSS JOIN (VALUES (30), (100)) w(win) LEFT JOIN (SELECT c.user_id, c.rank FROM mcand c JOIN mtruth t USING (user_id, item_id)) h USING (user_id) GROUP BY w.win, mu.user_id, mu.ndcg_10, mu.n_truth) GROUP BY win""")
def _(f: Frames):
    out = None
    for window in (30, 100):
        users = metrics.with_ceiling(metrics.per_user(f.mcand, f.mtruth, ks=(10,), window=window))
        part = users.agg(F.avg("ndcg_10").alias("ndcg"), F.avg("ceiling").alias("ceiling")).select(F.lit(window).alias("win"), "ndcg", "ceiling", (F.col("ndcg") / F.nullif(F.col("ceiling"), F.lit(0.0))).alias("eta"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("ra_ndcg", f"SELECT user_id, round(ndcg_10 / nullif(ceiling, 0), 6) AS ra_ndcg FROM ({CEILING})")
def _(f: Frames):
    return rounded(ceilings(f).select("user_id", (F.col("ndcg_10") / F.nullif(F.col("ceiling"), F.lit(0.0))).alias("ra_ndcg")))


@query("recall_diagnosis", f"SELECT round(avg(recall_100), 6) AS mean, round(median(recall_100), 6) AS median, round(stddev_samp(recall_100), 6) AS sd, round(avg(CASE WHEN m = 0 THEN 1 ELSE 0 END), 6) AS none_share, round(avg(CASE WHEN m = n_truth THEN 1 ELSE 0 END), 6) AS all_share, {_REGIME.format('avg(recall_100)')} AS regime FROM ({CEILING})")
def _(f: Frames):
    r = F.col("recall_100")
    return rounded(ceilings(f).agg(F.avg(r).alias("mean"), F.percentile(r, F.lit(0.5)).alias("median"), F.stddev_samp(r).alias("sd"), F.avg((F.col("m") == 0).cast("int")).alias("none_share"), F.avg((F.col("m") == F.col("n_truth")).cast("int")).alias("all_share"), metrics.regime(F.avg(r)).alias("regime")))


_FIVE = "CASE WHEN recall_100 <= 0 THEN 'none' WHEN recall_100 <= 0.1 THEN 'to_10' WHEN recall_100 <= 0.5 THEN 'to_50' WHEN recall_100 < 1 THEN 'below_all' ELSE 'all' END"


@query("recall_bins", f"SELECT {_FIVE} AS bin, count(*) AS n FROM ({CEILING}) GROUP BY 1")
def _(f: Frames):
    return ceilings(f).groupBy(metrics.five_bins(F.col("recall_100")).alias("bin")).agg(F.count("*").alias("n"))


@query("recall_bins_right", f"SELECT CASE WHEN recall_100 <= 0 THEN '0' WHEN recall_100 <= 0.05 THEN '(0,.05]' WHEN recall_100 <= 0.1 THEN '(.05,.1]' WHEN recall_100 <= 0.2 THEN '(.1,.2]' WHEN recall_100 <= 0.5 THEN '(.2,.5]' ELSE '(.5,1]' END AS bin, count(*) AS n FROM ({CEILING}) GROUP BY 1")
def _(f: Frames):
    return ceilings(f).groupBy(metrics.right_closed_bin(F.col("recall_100")).alias("bin")).agg(F.count("*").alias("n"))


@query("stratified_by_recall", f"SELECT CASE WHEN recall_100 <= 0 THEN 'zero' WHEN recall_100 < 0.1 THEN 'low' WHEN recall_100 < 0.5 THEN 'mid' ELSE 'high' END AS bin, count(*) AS n, round(avg(ndcg_10), 6) AS ndcg, round(avg(ceiling), 6) AS ceiling FROM ({CEILING}) GROUP BY 1")
def _(f: Frames):
    return rounded(ceilings(f).groupBy(metrics.recall_bin(F.col("recall_100")).alias("bin")).agg(F.count("*").alias("n"), F.avg("ndcg_10").alias("ndcg"), F.avg("ceiling").alias("ceiling")))


def _strata_sql(name: str) -> str:
    edges, last = metrics.STRATA[name]
    return "CASE " + " ".join(f"WHEN h.n <= {top} THEN '{label}'" for top, label in edges) + f" ELSE '{last}' END"


@query("strata_history", " UNION ALL ".join(f"SELECT '{s}' AS scheme, {_strata_sql(s)} AS stratum, count(*) AS n, round(avg(ndcg_10), 6) AS ndcg, round(avg(recall_20), 6) AS recall FROM mu JOIN (SELECT user_id, count(*) AS n FROM mtrain GROUP BY user_id) h USING (user_id) GROUP BY 2" for s in metrics.STRATA))
def _(f: Frames):
    users = f.mu.join(prepare.activity(f.mtrain).withColumnRenamed("n", "n_hist"), "user_id")
    schemes = F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), metrics.stratum(F.col("n_hist"), *metrics.STRATA[s]).alias("stratum")) for s in metrics.STRATA]))
    rows = users.select("ndcg_10", "recall_20", schemes.alias("s"))
    return rounded(rows.groupBy("s.scheme", "s.stratum").agg(F.count("*").alias("n"), F.avg("ndcg_10").alias("ndcg"), F.avg("recall_20").alias("recall")))


_KS = (10, 20, 50, 100)


@query("k_sweep", "SELECT k, round(avg(h / n), 6) AS recall FROM (SELECT s.user_id, k.k, any_value(s.n) AS n, count(x.rank) FILTER (x.rank <= k.k) AS h FROM (SELECT user_id, count(*) AS n FROM mtruth GROUP BY user_id) s CROSS JOIN (VALUES (10), (20), (50), (100)) k(k) LEFT JOIN (SELECT c.user_id, c.rank FROM mcand c JOIN mtruth t USING (user_id, item_id)) x USING (user_id) GROUP BY s.user_id, k.k) GROUP BY k")
def _(f: Frames):
    users = metrics.per_user(f.mcand, f.mtruth, ks=_KS)
    rows = users.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"recall_{k}").alias("r")) for k in _KS])).alias("x"))
    return rounded(rows.groupBy("x.k").agg(F.avg("x.r").alias("recall")))


_DIFF = "round(1 / (1 + ln(1 + CASE WHEN coalesce(rest, 0) > 0 THEN top / (rest + 1e-10) ELSE 1.0 END)), 9)"


@query("adaptive_k", f"SELECT user_id, round(d, 6) AS difficulty, CASE WHEN n < 100 THEN 500 ELSE least(greatest(CAST(floor(50 + d * 450) AS INTEGER), 50), 500) END AS k_user FROM (SELECT user_id, n, {_DIFF} AS d FROM (SELECT user_id, avg(score) FILTER (rank <= 50) AS top0, avg(score) FILTER (rank <= 100) AS top, avg(score) FILTER (rank > 100 AND rank <= 500) AS rest, count(*) AS n FROM (SELECT user_id, rank * 2 - 1 AS rank, score FROM cand) GROUP BY user_id))")
def _(f: Frames):
    spread = f.cand.withColumn("rank", F.col("rank") * 2 - 1)
    return rounded(metrics.adaptive_k(spread).withColumn("k_user", F.col("k_user")))


@query("adaptive_k_spread", "SELECT user_id, round(d, 6) AS difficulty, CAST(floor(100 + d * 200) AS INTEGER) AS k_user FROM (SELECT user_id, round(coalesce(1 - least(5 * stddev_pop(score), 1.0), 0.8), 9) AS d FROM cand GROUP BY user_id)")
def _(f: Frames):
    return rounded(metrics.adaptive_k_by_spread(f.cand))


@query("adaptive_k_lists", "SELECT c.user_id, c.rank, c.item_id FROM cand c WHERE c.rank <= 10 + c.user_id % 7")
def _(f: Frames):
    return retrieve.top_k(f.cand, 10 + F.col("user_id") % 7).select("user_id", "rank", "item_id")


_DENSITY = " UNION ALL ".join(f"SELECT * FROM (WITH tr AS (SELECT * FROM train WHERE {pair_hash_sql()} < {int(s * 2**32)}), cd AS ({_popularity('tr')}) SELECT {s}::DOUBLE AS share, (SELECT count(*) FROM tr) AS n_train, round(avg(h), 6) AS recall FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM cd WHERE cd.user_id = t.user_id AND cd.item_id = t.item_id) THEN 1.0 ELSE 0.0 END AS h FROM truth t))" for s in (1.0, 0.5, 0.25))


@query("density_sweep", _DENSITY)
def _(f: Frames):
    from stagewise.functions.arith import pair_hash32

    out = None
    for share in (1.0, 0.5, 0.25):
        # as keep_share; a user's items, candidates and truth meet in its row
        below = F.filter("own", lambda x: pair_hash32(F.col("user_id"), x) < F.lit(int(share * 2**32)))
        users = f.users.select("user_id", "truth", below.alias("own"))
        train = users.where(F.size("own") > 0)
        counts = kept(f.counts(train), "pop")
        found = retrieve.popular_lists(train, counts, 100).select(F.size(F.array_intersect("truth", F.transform("list", lambda x: x["item_id"]))).alias("hits"))
        hits = found.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
        part = hits.join(users.agg(F.sum(F.size("truth")).alias("n_truth"))).join(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_train")))
        part = part.select(F.lit(share).alias("share"), "n_train", (F.col("hits") / F.col("n_truth")).alias("recall"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


_BYGROUP = "SELECT h.n_hist % 8 AS g, log10(count(DISTINCT h.user_id)) AS x, avg(mu.recall_20) AS y FROM mu JOIN (SELECT user_id, count(*) AS n_hist FROM mtrain GROUP BY user_id) h USING (user_id) GROUP BY 1"


@query("catalog_regression", f"SELECT round(corr(y, x), 6) AS r, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM ({_BYGROUP})")
def _(f: Frames):
    rows = f.mu.join(prepare.activity(f.mtrain).withColumnRenamed("n", "n_hist"), "user_id").groupBy((F.col("n_hist") % 8).alias("g")).agg(F.log10(F.count_distinct("user_id")).alias("x"), F.avg("recall_20").alias("y"))
    return rounded(rows.agg(F.corr("y", "x").alias("r"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2")))


@query("random_floor", "SELECT k, round(k / (SELECT count(DISTINCT item_id) FROM train), 6) AS floor FROM (VALUES (20), (100)) t(k)")
def _(f: Frames):
    n = f.train.agg(F.count_distinct("item_id").alias("n"))
    return rounded(n.select(F.explode(F.array(F.lit(20), F.lit(100))).alias("k"), "n").select("k", (F.col("k") / F.col("n")).alias("floor")))


@query("oracle_gap", f"SELECT round(avg(ceiling), 6) AS oracle, round(avg(ndcg_10), 6) AS realistic, round((avg(ceiling) - avg(ndcg_10)) / nullif(avg(ceiling), 0) * 100, 6) AS gap_pct FROM ({CEILING})")
def _(f: Frames):
    best = metrics.per_user(rerank.oracle(f.mcand, f.mtruth), f.mtruth, ks=(10,)).agg(F.avg("ndcg_10").alias("oracle"))
    means = f.mu.agg(F.avg("ndcg_10").alias("realistic")).join(best)
    return rounded(means.select("oracle", "realistic", ((F.col("oracle") - F.col("realistic")) / F.nullif(F.col("oracle"), F.lit(0.0)) * 100).alias("gap_pct")))


_GOLD = "SELECT user_id, min(item_id) AS item_id FROM mtruth t WHERE NOT EXISTS (SELECT 1 FROM mcand c WHERE c.user_id = t.user_id AND c.item_id = t.item_id AND c.rank <= 30) GROUP BY user_id"


@query("arms_all", f"""
SELECT * FROM (WITH p AS (SELECT user_id, rank, item_id, count(*) OVER (PARTITION BY user_id) AS size FROM mcand WHERE rank <= 30), g AS ({_GOLD})
SELECT 'as_is' AS arm, user_id, rank, item_id FROM p
UNION ALL SELECT 'drop_hits', user_id, row_number() OVER (PARTITION BY user_id ORDER BY rank), item_id FROM p WHERE NOT EXISTS (SELECT 1 FROM mtruth t WHERE t.user_id = p.user_id AND t.item_id = p.item_id)
UNION ALL SELECT 'gold_last', p.user_id, rank, CASE WHEN rank = size AND g.item_id IS NOT NULL THEN g.item_id ELSE p.item_id END FROM p LEFT JOIN g USING (user_id)
UNION ALL SELECT 'gold_first', p.user_id, CASE WHEN g.item_id IS NULL THEN rank ELSE rank + 1 END, p.item_id FROM p LEFT JOIN g USING (user_id) WHERE g.item_id IS NULL OR rank < size
UNION ALL SELECT 'gold_first', user_id, 1, g.item_id FROM g
UNION ALL SELECT 'shuffled', user_id, row_number() OVER (PARTITION BY user_id ORDER BY {pair_hash_sql()}, item_id), item_id FROM p)""")
def _(f: Frames):
    gold = f.mtruth.join(f.mcand.where("rank <= 30"), ["user_id", "item_id"], "left_anti").groupBy("user_id").agg(F.min("item_id").alias("item_id"))
    return rerank.arms(f.mcand, f.mtruth, gold, 30)


def _mixed_sql(items: str, seed: int = 42) -> str:
    return f"list_transform(list_sort(list_transform({items}, lambda v: {{'h': {pair_hash_sql(seed, 'user_id', 'v')}, 'v': v}})), lambda s: s.v)"


@query("arms_six", f"""
SELECT * FROM (WITH l AS (SELECT user_id, list(item_id ORDER BY rank) AS x FROM mcand101 GROUP BY user_id HAVING count(*) = 101),
g AS (SELECT user_id, list_sort(list(DISTINCT item_id)) AS gt FROM mtruth GROUP BY user_id), h AS (SELECT user_id, list(DISTINCT item_id) AS met FROM mtrain GROUP BY user_id),
j AS (SELECT user_id, x[1:100] AS b, x[101] AS filler, list_filter(gt, lambda v: NOT list_contains(x[1:100], v)) AS missed, coalesce(met, []) AS met FROM l JOIN g USING (user_id) LEFT JOIN h USING (user_id)),
i AS (SELECT *, coalesce({_mixed_sql('list_filter(missed, lambda v: NOT list_contains(met, v))', 43)}[1], filler) AS ins, list_concat(b[1:90], missed)[1:100] AS o FROM j),
k AS (SELECT *, list_concat(o, list_filter(b[91:100], lambda v: NOT list_contains(o, v)))[1:100] AS o2 FROM i),
a AS (SELECT user_id, 'R' AS arm, b AS x FROM k UNION ALL SELECT user_id, 'drop30', list_concat(b[1:29], [filler], b[31:100]) FROM k UNION ALL SELECT user_id, 'gold30', list_concat(b[1:29], [ins], b[31:100]) FROM k
 UNION ALL SELECT user_id, 'gold01', list_concat([ins], b[1:29], b[31:100]) FROM k UNION ALL SELECT user_id, 'shuffle', list_concat({_mixed_sql('b[1:30]')}, b[31:100]) FROM k UNION ALL SELECT user_id, 'oracle', {_mixed_sql('o2')} FROM k)
SELECT arm, user_id, generate_subscripts(x, 1) AS rank, unnest(x) AS item_id FROM a)""")
def _(f: Frames):
    return rerank.interventions(f.mcand101, f.mtruth, f.mtrain)


@query("oracle_injection", f"""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY {pair_hash_sql()}, item_id) AS rank, item_id FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source, rank, item_id) AS pl FROM (
  SELECT user_id, item_id, min(source) AS source, min(rank) AS rank FROM (SELECT user_id, item_id, 1 AS source, rank FROM mcand WHERE rank <= 26 UNION ALL SELECT user_id, item_id, 0, 0 FROM mtruth) GROUP BY user_id, item_id)) WHERE pl <= 30""")
def _(f: Frames):
    return rerank.injected(f.mcand, f.mtruth, 30, 26).select("user_id", "rank", "item_id")


@query("controlled_recall", f"""
SELECT target, user_id, pl AS rank, item_id, CASE WHEN source = 0 THEN 'gold' ELSE 'fill' END AS source FROM (
 SELECT *, row_number() OVER (PARTITION BY target, user_id ORDER BY source, rank, item_id) AS pl FROM (
  SELECT target, user_id, 0 AS source, nth AS rank, item_id FROM (SELECT user_id, item_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY {pair_hash_sql()}, item_id) AS nth FROM mtruth), (VALUES (0.0::DOUBLE), (0.4), (1.0)) a(target) WHERE nth <= floor(target * n + 1e-9)
  UNION ALL SELECT target, user_id, 1, rank, item_id FROM mcand c, (VALUES (0.0::DOUBLE), (0.4), (1.0)) a(target) WHERE NOT EXISTS (SELECT 1 FROM mtruth t WHERE t.user_id = c.user_id AND t.item_id = c.item_id) AND user_id IN (SELECT user_id FROM mtruth))) WHERE pl <= 20""")
def _(f: Frames):
    out = None
    for target in (0.0, 0.4, 1.0):
        part = rerank.controlled(f.mcand, f.mtruth, F.lit(target), 20).select(F.lit(target).alias("target"), "user_id", "rank", "item_id", "source")
        out = part if out is None else out.unionByName(part)
    return out


@query("kendall_tau", "SELECT a.user_id, round(sum(sign(b.new_place - a.new_place)) / count(*), 6) AS tau FROM places a JOIN places b ON a.user_id = b.user_id AND a.place < b.place GROUP BY a.user_id")
def _(f: Frames):
    return rounded(metrics.kendall_tau(f.places))


_RERANKERS = "SELECT 'as_is' AS reranker, user_id, rank, item_id FROM mcand UNION ALL SELECT 'reverse', user_id, row_number() OVER (PARTITION BY user_id ORDER BY rank DESC), item_id FROM mcand UNION ALL SELECT 'random', user_id, rank, item_id FROM mshuffled"


@query("full_protocol", f"""
SELECT r.reranker, CASE WHEN c.m = 0 THEN 'zero' WHEN c.recall_100 < 0.1 THEN 'low' WHEN c.recall_100 < 0.5 THEN 'mid' ELSE 'high' END AS bin, count(DISTINCT c.user_id) AS users, round(sum(CASE WHEN t.item_id IS NOT NULL AND r.rank <= 10 THEN 1 / log2(r.rank + 1) / (SELECT v FROM idcg WHERE k = 10 AND idcg.n = least(c.n_truth, 10)) ELSE 0 END) / count(DISTINCT c.user_id), 6) AS ndcg, round(sum(DISTINCT c.ceiling + c.user_id * 1000) / count(DISTINCT c.user_id) - avg(DISTINCT c.user_id) * 1000, 5) AS ceiling
FROM ({CEILING}) c JOIN ({_RERANKERS}) r USING (user_id) LEFT JOIN mtruth t ON t.user_id = r.user_id AND t.item_id = r.item_id GROUP BY 1, 2""")
def _(f: Frames):
    base = ceilings(f).select("user_id", "m", "ceiling", metrics.recall_bin(F.col("recall_100")).alias("bin"))
    out = None
    for name, df in {"as_is": f.mcand, "reverse": rerank.reverse(f.mcand), "random": rerank.shuffled(f.mcand)}.items():
        part = metrics.per_user(df, f.mtruth, ks=(10,)).join(base.drop("m"), "user_id").groupBy("bin").agg(F.count("*").alias("users"), F.avg("ndcg_10").alias("ndcg"), F.round(F.avg("ceiling"), 5).alias("ceiling")).withColumn("reranker", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("top10_agreement", "SELECT a.user_id, round(count(b.item_id) / 10, 6) AS agreement FROM (SELECT * FROM mcand WHERE rank <= 10) a LEFT JOIN (SELECT * FROM mshuffled WHERE rank <= 10) b USING (user_id, item_id) GROUP BY a.user_id")
def _(f: Frames):
    from stagewise.operators.graph import neighbour_agreement

    return rounded(neighbour_agreement(f.mcand, rerank.shuffled(f.mcand)))


@query("report_rollup", "SELECT coalesce(scheme, 'all') AS scheme, coalesce(bin, 'all') AS bin, count(*) AS n, round(avg(ndcg_10), 6) AS ndcg FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS scheme, CASE WHEN recall_20 > 0 THEN 'hit' ELSE 'miss' END AS bin, ndcg_10 FROM mu) GROUP BY ROLLUP (scheme, bin)")
def _(f: Frames):
    rows = f.mu.select(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("scheme"), F.when(F.col("recall_20") > 0, "hit").otherwise("miss").alias("bin"), "ndcg_10")
    g = rows.rollup("scheme", "bin").agg(F.count("*").alias("n"), F.avg("ndcg_10").alias("ndcg"))
    return rounded(g.select(F.coalesce("scheme", F.lit("all")).alias("scheme"), F.coalesce("bin", F.lit("all")).alias("bin"), "n", "ndcg"))


@query("llm_two_stage", f"""
SELECT status, count(*) AS users, round(avg(ndcg_10), 6) AS ndcg FROM (SELECT user_id, ndcg_10 FROM ({_metrics('placed', 'truth', (10,)).replace('FROM placed c', 'FROM (SELECT c.user_id, coalesce(p.new_place + 1, c.rank) AS rank, c.item_id FROM cand c LEFT JOIN places p USING (user_id, item_id)) c')})) JOIN (SELECT user_id, CASE WHEN len(order_) > 0 THEN 'some' ELSE 'none' END AS status FROM named) USING (user_id) GROUP BY status""")
def _(f: Frames):
    n = f.cand.where("rank <= 30").groupBy("user_id").agg(F.count("*").alias("n"))
    orders = f.replies.join(n, "user_id").select("user_id", replies.positions(F.col("reply"), F.col("n")).alias("order"))
    users = metrics.per_user(replies.apply_order(f.cand, orders, 30), f.truth, ks=(10,))
    some = f.replies.select("user_id", F.when(replies.numbers_found(F.col("reply"), F.lit(30)) > 0, "some").otherwise("none").alias("status"))
    return rounded(users.join(some, "user_id").groupBy("status").agg(F.count("*").alias("users"), F.avg("ndcg_10").alias("ndcg")))


