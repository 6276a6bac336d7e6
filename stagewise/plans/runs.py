"""Sources, checkpoints, costs, reports and traces."""

from __future__ import annotations

from stagewise.functions.arith import softmax
from stagewise.plans.base import F, Frames, query, rounded
from stagewise.sources import runs, tables
from stagewise.streaming import detector, logs

_LAST = "SELECT * EXCLUDE nth FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS nth FROM events) WHERE nth = 1"


@query("checkpoint_last_wins", _LAST)
def _(f: Frames):
    return runs.last_record(f.table("events"), "ts").select(F.col("user_id").cast("string").alias("user_id"), "event_id", "value")


@query("resume_pending", "SELECT DISTINCT c_custkey AS user_id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events)")
def _(f: Frames):
    return runs.pending(f.table("customer").select(F.col("c_custkey").alias("user_id")).distinct(), f.table("events").select("user_id"))


@query("reconcile_aggregates", "SELECT e.event_type AS name, count(*) AS n, round(avg(value), 6) AS mean, round(avg(value) + CASE WHEN e.event_type < 'd' THEN 0 ELSE 1 END, 6) AS expected, e.event_type < 'd' AS agrees FROM events e GROUP BY e.event_type")
def _(f: Frames):
    rows = f.table("events").select(F.col("event_type").alias("name"), "value")
    told = rows.groupBy("name").agg(F.avg("value").alias("v")).select("name", (F.col("v") + F.when(F.col("name") < "d", 0).otherwise(1)).alias("expected"))
    return rounded(runs.reconcile(rows, told))


@query("cost_rollup", "SELECT model, calls, tokens_in, tokens_out, round((tokens_in * usd_in + tokens_out * usd_out) / 1e6, 6) AS usd FROM (SELECT event_type AS model, count(*) AS calls, CAST(sum(event_id % 900 + 100) AS BIGINT) AS tokens_in, CAST(sum(event_id % 90) AS BIGINT) AS tokens_out FROM events GROUP BY 1) JOIN (SELECT DISTINCT event_type AS model, length(event_type) * 0.1::DOUBLE AS usd_in, length(event_type) * 0.4::DOUBLE AS usd_out FROM events) USING (model)")
def _(f: Frames):
    e = f.table("events")
    prices = e.select(F.col("event_type").alias("model")).distinct().select("model", (F.length("model") * 0.1).alias("usd_in"), (F.length("model") * 0.4).alias("usd_out"))
    return rounded(runs.cost(e.select(F.col("event_type").alias("model"), (F.col("event_id") % 900 + 100).alias("n_in"), (F.col("event_id") % 90).alias("n_out")), prices))


@query("report_json", "SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def _(f: Frames):
    rows = f.table("events").groupBy("event_type").agg(F.count("*").alias("n"), F.lit(float("nan")).alias("nothing"))
    return runs.report(rows, ["event_type"]).select("event_type", F.get_json_object("report", "$.n").cast("long").alias("n"))


@query("id_collisions", "SELECT CAST(s AS BIGINT) AS as_number, count(*) AS n FROM (SELECT DISTINCT CASE WHEN event_id % 4 = 0 AND user_id % 3 = 0 THEN '0' || user_id ELSE CAST(user_id AS VARCHAR) END AS s FROM events) GROUP BY 1 HAVING count(*) > 1")
def _(f: Frames):
    spelt = F.when((F.col("event_id") % 4 == 0) & (F.col("user_id") % 3 == 0), F.concat(F.lit("0"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    return runs.id_collisions(f.table("events").select(spelt.alias("user_id")))


@query("news_scan", "SELECT 'N' || p_partkey AS news_id, p_brand AS category, p_type AS subcategory, p_name AS title, 'size ' || p_size AS abstract, p_name || '. size ' || p_size AS text FROM part WHERE p_partkey % 4 > 0")
def _(f: Frames):
    p = f.table("part")
    line = F.concat_ws("\t", F.concat(F.lit("N"), F.col("p_partkey").cast("string")), "p_brand", "p_type", "p_name", F.concat(F.lit("size "), F.col("p_size").cast("string")))
    return tables.news(p.select(F.when(F.col("p_partkey") % 4 > 0, line).otherwise("broken\tline").alias("value")))


@query("behaviour_scan", """
SELECT * FROM (WITH b AS (SELECT o_orderkey AS k, 'U' || o_custkey AS u, o_orderkey % 6 = 0 AS bad, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 1577836800 + (o_orderkey % 1000) * 60 END AS t FROM orders)
SELECT u AS raw_user, 'I' || (k % 17) AS raw_item, t AS ts FROM b UNION ALL SELECT u, 'H' || (k % 13), t - 2 FROM b UNION ALL SELECT u, 'H' || (k % 11), t - 1 FROM b)""")
def _(f: Frames):
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    when = F.date_format(F.timestamp_seconds(F.lit(1577836800) + (k % 1000) * 60), "M/d/yyyy h:mm:ss a")
    line = F.concat_ws("\t", text(k), F.concat(F.lit("U"), text(F.col("o_custkey"))), F.when(k % 6 == 0, "no time").otherwise(when), F.concat(F.lit("H"), text(k % 13), F.lit(" H"), text(k % 11)), F.concat(F.lit("I"), text(k % 17), F.lit("-1 J"), text(k % 5), F.lit("-0")))
    return tables.behaviours(f.table("orders").select(line.alias("value")))


@query("json_metadata", "SELECT p_partkey AS item_id, p_name AS title, substring(p_name || ' ' || p_type, 1, 12) AS text FROM part")
def _(f: Frames):
    p = f.table("part")
    value = F.to_json(F.map_from_arrays(F.array(F.col("p_partkey").cast("string")), F.array(F.struct(F.col("p_name").alias("title"), F.concat_ws(" ", "p_name", "p_type").alias("text")))))
    return tables.item_metadata(p.select(value.alias("value")), 12).select("item_id", "title", "text")


@query("title_metadata", "SELECT item_id, title FROM (SELECT item_id, 'order ' || k1 AS title, row_number() OVER (PARTITION BY item_id ORDER BY ts, k1, k2, user_id, k3) AS nth FROM inter) WHERE nth = 1")
def _(f: Frames):
    rows = f.inter.withColumn("title", F.concat(F.lit("order "), F.col("k1").cast("string")))
    return tables.metadata_from_titles(rows, ["ts", "k1", "k2", "user_id", "k3"])


def trace(f: Frames):
    return f.table("events").select((F.col("event_id") % 3).alias("run_id"), F.col("event_id").alias("step"), F.when(F.floor(F.col("event_id") / 150) % 2 == 0, F.lit(5.0) + (F.col("event_id") % 7) * 0.01).otherwise(F.col("value")).alias("value"))


_TRACE = "SELECT event_id % 3 AS run_id, event_id AS step, CASE WHEN (event_id // 150) % 2 = 0 THEN 5.0 + (event_id % 7) * 0.01 ELSE value END AS value FROM events"


@query("plateau_jumps", f"""
SELECT * FROM (WITH t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS pl FROM ({_TRACE})),
f AS (SELECT *, coalesce(count(*) OVER w = 20 AND stddev_pop(value) OVER w < 0.5 AND abs(regr_slope(value, pl) OVER w) < 0.1, false) AS flat FROM t WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
i AS (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY step) AS island FROM f),
g AS (SELECT run_id, island, count(*) AS flat_points, avg(value) AS mean, stddev_pop(value) AS dev FROM i WHERE flat GROUP BY run_id, island HAVING count(*) >= 5)
SELECT i.run_id, i.step, i.value, g.flat_points, round(abs(i.value - g.mean) / (g.dev + 1e-10), 6) AS z FROM i JOIN g ON g.run_id = i.run_id AND g.island = i.island - 1 WHERE NOT i.flat AND abs(i.value - g.mean) / (g.dev + 1e-10) > 2)""")
def _(f: Frames):
    return detector.jumps(trace(f))


def stairs(f: Frames):
    """Runs whose value climbs and falls by stairs of 300 events."""
    k = F.col("event_id")
    return f.table("events").select((k % 3).alias("run_id"), k.alias("step"), (F.floor(k / 300) % 4 + (F.col("value") - 50) / 1000).alias("value"))


_STAIRS = "SELECT event_id % 3 AS run_id, event_id AS step, (event_id // 300) % 4 + (value - 50) / 1000 AS value FROM events"


@query("plateau_leaps", f"""
SELECT run_id, start AS plateau_start, step, step - start AS duration, round(before, 6) AS before, round(value, 6) AS after FROM (
 SELECT *, last_value(CASE WHEN flat AND NOT was THEN step END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS start FROM (
  SELECT *, coalesce(lag(flat) OVER (PARTITION BY run_id ORDER BY step), false) AS was FROM (
   SELECT *, pl >= 40 AND sd < 0.5 AND abs(slope) < 0.5 / 20 AS flat FROM (
    SELECT *, lag(value, 39) OVER w AS before, stddev_pop(value) OVER rest AS sd, coalesce(regr_slope(value, pl) OVER rest, 0) AS slope, avg(value) OVER late AS now,
     avg(value) OVER early AS base, stddev_pop(value) OVER early AS dev, count(value) OVER early AS n, coalesce(regr_slope(value, pl) OVER tail, 0) AS ending
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY step) AS DOUBLE) AS pl FROM ({_STAIRS}))
    WINDOW w AS (PARTITION BY run_id ORDER BY step), rest AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), late AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
     early AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 79 PRECEDING AND 20 PRECEDING), tail AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)))))
WHERE NOT flat AND was AND step - start >= 20 AND n >= 10 AND dev >= 1e-6 AND (now - base) / dev > 2 AND (pl < 10 OR ending >= -0.5 / 10)""")
def _(f: Frames):
    return rounded(detector.leaps(stairs(f), detector.LeapRule(window=40, delta=0.5, patience=20, sustain=10)))


@query("checkpoint_store", _LAST)
def _(f: Frames):
    """The event table streamed into a store, and its last record per user."""
    from stagewise.functions.lineage import folder
    from stagewise.sources.store import CheckpointStore

    events = f.table("events")
    store = CheckpointStore(f.spark, folder(f.spark, "store"), events.schema)
    store.save_stream(logs.table_stream(f.spark, f"{f.sf_dir}/events.parquet*", events.schema)).awaitTermination()
    return store.finalise(folder(f.spark, "events")).select(F.col("user_id").cast("string").alias("user_id"), "event_id", "value")


@query("emergence_points", f"SELECT run_id, step, round(rise, 6) AS rise FROM (SELECT run_id, step, count(*) OVER w AS n, value - avg(value) OVER w AS rise FROM ({_TRACE}) WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)) WHERE n >= 5 AND rise > 0.1")
def _(f: Frames):
    return detector.emergence(trace(f))


@query("epoch_jumps", f"SELECT run_id, min(step) AS step FROM (SELECT run_id, step, value, count(*) OVER w AS n, avg(value) OVER w AS mean, var_pop(value) OVER w AS v FROM ({_TRACE}) WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE n = 10 AND v < 0.01 AND value - mean > 0.05 GROUP BY run_id")
def _(f: Frames):
    return detector.epoch_jumps(trace(f), variance=0.01)


@query("half_jump", f"SELECT run_id, round((avg(value) FILTER (b <= 50) - avg(value) FILTER (b > 50)) / (stddev_pop(value) FILTER (b > 50) + 1e-10), 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS b FROM ({_TRACE})) WHERE b <= 100 GROUP BY run_id")
def _(f: Frames):
    return detector.half_jump(trace(f), 100)


@query("events_tumbling", "SELECT date_trunc('hour', ts) AS begin, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(f: Frames):
    return logs.tumbling(f.table("events"))


@query("events_sessions", """
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (
 SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def _(f: Frames):
    return logs.sessions(f.table("events"))


@query("split_round_trip", "SELECT 'train' AS split, count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(item_id) AS BIGINT) AS items FROM train UNION ALL SELECT 'test', count(*), count(DISTINCT user_id), CAST(sum(item_id) AS BIGINT) FROM truth")
def _(f: Frames):
    from stagewise.functions.lineage import folder

    path = folder(f.spark, "splits")
    tables.write_splits(f.loo, path)
    dataset = tables.Dataset("splits", path)
    parts = [tables.split_scan(f.spark, dataset, s).groupBy(F.lit(s).alias("split")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum("item_id").alias("items")) for s in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query("agreement_by_activity", """
SELECT tier, count(*) AS n, round(-sum(p * ln(p)), 6) AS entropy FROM (
 SELECT tier, expert, count(*) / sum(count(*)) OVER (PARTITION BY tier) AS p FROM (
  SELECT CASE WHEN n < 30 THEN 'low' WHEN n < 45 THEN 'mid' ELSE 'high' END AS tier, CASE WHEN t.item_id % 5 = 0 THEN 1 ELSE 0 END AS expert FROM train t JOIN (SELECT user_id, count(*) AS n FROM train GROUP BY user_id) u USING (user_id)) GROUP BY tier, expert) GROUP BY tier""")
def _(f: Frames):
    from stagewise.operators.graph import router_entropy

    tier = F.when(F.col("n") < 30, "low").when(F.col("n") < 45, "mid").otherwise("high")
    n = f.train.groupBy("user_id").agg(F.count("*").alias("n"))
    rows = f.train.join(n, "user_id").select(tier.alias("tier"), (F.col("item_id") % 5 == 0).cast("int").alias("expert"))
    return router_entropy(rows, "tier").withColumn("entropy", F.round("entropy", 6))


@query("event_sliding", "SELECT w AS begin, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w FROM events) GROUP BY 1, 2")
def _(f: Frames):
    return logs.sliding(f.table("events"))


@query("first_records", "SELECT user_id, event_type, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) = 1")
def _(f: Frames):
    return logs.first_records(f.table("events").select("user_id", "event_type", "ts", "value"), ["user_id", "event_type"])


@query("softmax_shares", "SELECT user_id, item_id, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS share FROM (SELECT user_id, item_id, exp((score - max(score) OVER (PARTITION BY user_id)) / 0.5) AS e FROM cand)")
def _(f: Frames):
    return rounded(f.cand.select("user_id", "item_id", softmax("score", 0.5, "user_id").alias("share")))


@query("dataset_listing", """
SELECT 'counted' AS name, 'a' AS domain, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_train, (SELECT count(*) FROM truth) AS n_test, round(100 * count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)), 6) AS density, true AS present FROM train
UNION ALL SELECT 'told', 'a', count(DISTINCT user_id), count(DISTINCT event_type), count(*), 0, 12.5, true FROM events UNION ALL SELECT 'missing', 'b', 0, 0, 0, 0, 0.0, false""")
def _(f: Frames):
    """One dataset that is counted, one that its statistics file answers for, one that isn't there."""
    from stagewise.functions.lineage import folder

    counted, told = folder(f.spark, "counted"), folder(f.spark, "told")
    tables.write_splits(f.loo, counted)
    f.table("events").select("user_id").write.parquet(f"{told}/train.parquet")
    numbers = f.table("events").agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("event_type").alias("n_items"), F.count("*").alias("n_train"), F.lit(12.5).alias("density_pct"))
    numbers.coalesce(1).write.json(f"{told}/dataset_stats.json")
    registry = tables.Registry()
    for name, path, domain in (("counted", counted, "a"), ("told", told, "a"), ("missing", f"{told}/none", "b")):
        registry.add(tables.Dataset(name, path, domain=domain))
    return rounded(tables.listing(f.spark, registry))


@query("loo_preferred", "SELECT user_id, item_id FROM truth")
def _(f: Frames):
    """The test split is read from the leave-one-out file where a dataset has one beside another test file."""
    from stagewise.functions.lineage import folder

    path = folder(f.spark, "loo")
    rows = f.multi.select("user_id", "item_id", "ts", "split").unionByName(f.loo.where("split = 'test'").select("user_id", "item_id", "ts", F.lit("test_loo").alias("split")))
    tables.write_splits(rows, path)
    return tables.split_scan(f.spark, tables.Dataset("both", path, has_loo=True), "test").select("user_id", "item_id")


@query("ratings_scan", "SELECT user_id, item_id, CAST(rating AS DOUBLE) AS rating, CAST(k1 AS BIGINT) AS timestamp FROM inter")
def _(f: Frames):
    from stagewise.functions.lineage import folder

    path = folder(f.spark, "ratings")
    f.inter.select(F.col("user_id").alias("userId"), F.col("item_id").alias("movieId"), F.col("rating").cast("double").alias("rating"), F.col("k1").alias("timestamp")).write.option("header", True).csv(path)
    return tables.ratings_csv(f.spark, path)


@query("checkpoint_append", "SELECT CAST(user_id AS VARCHAR) AS user_id, round(CASE WHEN user_id % 2 = 0 THEN min(value) ELSE max(value) END, 6) AS ndcg FROM events GROUP BY events.user_id")
def _(f: Frames):
    """Records appended twice; of users in both, the later record holds."""
    from stagewise.functions.lineage import folder

    path = folder(f.spark, "log")
    events = f.table("events").groupBy("user_id")
    named = F.col("user_id").cast("string").alias("user_id")
    runs.append_checkpoint(events.agg(F.max("value").alias("ndcg")).select(named, "ndcg"), path)
    runs.append_checkpoint(events.agg(F.min("value").alias("ndcg")).where("user_id % 2 = 0").select(named, "ndcg"), path)
    return rounded(runs.read_checkpoint(f.spark, path).select("user_id", "ndcg"))


@query("history_round_trip", f"SELECT run_id, step, round(value, 6) AS value FROM ({_TRACE})")
def _(f: Frames):
    from stagewise.functions.lineage import folder

    path = folder(f.spark, "history")
    runs.history_csv(trace(f), path)
    return rounded(f.spark.read.schema("run_id long, step long, value double").csv(path, header=True))


@query("checkpoint_log", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def _(f: Frames):
    return logs.latest_per_user(f.table("events")).select("user_id", "event_id", "value")
