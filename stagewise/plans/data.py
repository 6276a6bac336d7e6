"""Preparation, splits and statistics."""

from __future__ import annotations

from stagewise.operators import prepare, split
from stagewise.plans.base import ORDER, F, Frames, hash_sql, pair_hash_sql, query, rounded

ROW = "user_id, item_id, k1, k2, k3"


def _row(df):
    return df.select("user_id", "item_id", "k1", "k2", "k3")


@query("implicit_filter", f"SELECT {ROW}, rating FROM inter WHERE rating >= 4.0")
def _(f: Frames):
    return prepare.implicit(f.inter).select("user_id", "item_id", "k1", "k2", "k3", "rating")


@query("dedup_keep_first", f"SELECT {ROW} FROM pairs")
def _(f: Frames):
    return _row(f.pairs)


def _core_sql(rounds: int, users: int, items: int, alternating: bool = False) -> str:
    out, now = "", "(SELECT user_id, item_id FROM pairs)"
    parts = []
    for r in range(rounds):
        u = f"SELECT user_id FROM r{r} GROUP BY user_id HAVING count(*) >= {users}"
        first = f"u{r} AS (SELECT * FROM r{r} WHERE user_id IN ({u}))"
        counted = f"u{r}" if alternating else f"r{r}"
        parts += [first, f"r{r + 1} AS (SELECT * FROM u{r} WHERE item_id IN (SELECT item_id FROM {counted} GROUP BY item_id HAVING count(*) >= {items}))"]
    out = f"SELECT * FROM (WITH r0 AS {now}, " + ", ".join(parts) + f" SELECT user_id, item_id FROM r{rounds})"
    return out


@query("kcore5", _core_sql(4, 5, 5))
def _(f: Frames):
    return prepare.core(f.pairs.select("user_id", "item_id"), 5)


@query("kcore_dense_items", _core_sql(4, 20, 26))
def _(f: Frames):
    return prepare.core(f.pairs.select("user_id", "item_id"), 20, 26, rounds=4)


@query("kcore_alternating", _core_sql(4, 25, 20, True))
def _(f: Frames):
    return prepare.core(f.pairs.select("user_id", "item_id"), 25, 20, rounds=4, alternating=True)


@query("kcore_three_rounds", _core_sql(3, 20, 30))
def _(f: Frames):
    return prepare.core(f.pairs.select("user_id", "item_id"), 20, 30, rounds=3)


@query("metadata_semi", "SELECT user_id, item_id FROM pairs WHERE item_id IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(f: Frames):
    return prepare.with_metadata(f.pairs, f.table("part").where("p_size > 10").select(F.col("p_partkey").alias("item_id"))).select("user_id", "item_id")


@query("id_map", "SELECT raw_id, row_number() OVER (ORDER BY raw_id) - 1 AS dense_id FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS raw_id FROM pairs)")
def _(f: Frames):
    return prepare.dense_ids(f.pairs.select(F.col("user_id").cast("string").alias("raw")), "raw")


@query("top_users", "SELECT user_id, item_id FROM pairs WHERE user_id IN (SELECT user_id FROM (SELECT user_id, count(*) AS n FROM pairs GROUP BY user_id) ORDER BY n DESC, user_id LIMIT 50)")
def _(f: Frames):
    return prepare.top_users(f.pairs, 50).select("user_id", "item_id")


@query("topuser_hash_mix", f"""
SELECT user_id, item_id FROM pairs WHERE user_id IN (
  SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY (pl > 50), CASE WHEN pl > 50 THEN h END, user_id) AS place
    FROM (SELECT user_id, {hash_sql('user_id')} AS h, row_number() OVER (ORDER BY n DESC, user_id) AS pl FROM (SELECT user_id, count(*) AS n FROM pairs GROUP BY user_id))) WHERE place <= 100)""")
def _(f: Frames):
    return prepare.active_and_drawn_users(f.pairs, 100).select("user_id", "item_id")


_CATALOG = "(SELECT item_id FROM pop ORDER BY n DESC, item_id LIMIT 100)"


@query("catalog_subsample", f"""
SELECT 'train' AS part, user_id, item_id FROM train WHERE item_id IN {_CATALOG}
UNION ALL SELECT 'test', user_id, item_id FROM truth WHERE item_id IN {_CATALOG} AND user_id IN (SELECT user_id FROM train WHERE item_id IN {_CATALOG})""")
def _(f: Frames):
    train, test = prepare.popular_catalog(f.train, f.truth, 100)
    return train.select(F.lit("train").alias("part"), "user_id", "item_id").unionByName(test.select(F.lit("test").alias("part"), "user_id", "item_id"))


@query("bernoulli_keep", f"SELECT user_id, item_id FROM train WHERE {pair_hash_sql()} < 2147483648")
def _(f: Frames):
    return prepare.keep_share(f.train, 0.5).select("user_id", "item_id")


_ELIGIBLE = "SELECT t.user_id, t.n AS n_history, g.n AS n_truth FROM (SELECT user_id, count(*) AS n FROM train GROUP BY user_id HAVING count(*) >= 3) t JOIN (SELECT user_id, count(DISTINCT item_id) AS n FROM truth GROUP BY user_id) g USING (user_id)"


@query("eligible_users", _ELIGIBLE)
def _(f: Frames):
    return prepare.eligible(f.train, f.truth)


@query("user_sample", f"SELECT user_id FROM ({_ELIGIBLE}) ORDER BY {hash_sql('user_id')}, user_id LIMIT 100")
def _(f: Frames):
    return prepare.draw_users(prepare.eligible(f.train, f.truth), 100).select("user_id")


@query("disjoint_pools", f"""
SELECT user_id, 'eval' AS pool FROM (SELECT user_id FROM ({_ELIGIBLE}) ORDER BY {hash_sql('user_id')}, user_id LIMIT 60)
UNION ALL SELECT user_id, 'train' FROM (SELECT user_id FROM ({_ELIGIBLE}) WHERE n_history >= 4 AND user_id NOT IN (SELECT user_id FROM ({_ELIGIBLE}) ORDER BY {hash_sql('user_id')}, user_id LIMIT 60) ORDER BY {hash_sql('user_id', 43)}, user_id LIMIT 40)""")
def _(f: Frames):
    return prepare.disjoint_pools(f.train, f.truth, 60, 40)


@query("half_split", f"""
SELECT user_id, CASE WHEN pl <= greatest(50, total // 2) THEN 'a' ELSE 'b' END AS half
FROM (SELECT user_id, row_number() OVER (ORDER BY {hash_sql('user_id')}, user_id) AS pl, count(*) OVER () AS total FROM (SELECT DISTINCT user_id FROM truth))""")
def _(f: Frames):
    return prepare.half_split(f.truth.select("user_id").distinct())


@query("closed_open_catalog", "SELECT user_id, item_id, CASE WHEN item_id IN (SELECT item_id FROM train WHERE item_id % 3 > 0) THEN 'closed' ELSE 'open' END AS side FROM truth")
def _(f: Frames):
    return prepare.catalog_side(f.train.where("item_id % 3 > 0"), f.truth)


@query("null_control", "SELECT bool_and(CASE WHEN doc_id % 3 = 0 THEN text END IS NULL) AS all_null, count(*) AS n_rows FROM documents")
def _(f: Frames):
    return prepare.all_null(f.table("documents").select(F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("text")), "text")


@query("item_text_fallback", "SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN p_name ELSE 'Item ' || p_partkey END AS text FROM part")
def _(f: Frames):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.col("p_type")).when(k == 1, "  ")
    title = F.when(k == 2, "").otherwise(F.col("p_name"))
    return f.table("part").select(F.col("p_partkey").alias("item_id"), prepare.text_of(text, title, F.col("p_partkey")).alias("text"))


@query("dataset_stats", """
SELECT n_train, users_train, items_train, n_all, users_all, items_all, round(n_train / (users_train * items_train), 6) AS density,
 round(n_all / users_all / items_train * 100, 6) AS density_pct, round(n_all / users_all, 6) AS per_user, items_all - items_train AS open_items
FROM (SELECT count(*) AS n_train, count(DISTINCT user_id) AS users_train, count(DISTINCT item_id) AS items_train FROM train),
 (SELECT count(*) AS n_all, count(DISTINCT user_id) AS users_all, count(DISTINCT item_id) AS items_all FROM (SELECT user_id, item_id FROM train UNION ALL SELECT user_id, item_id FROM truth))""")
def _(f: Frames):
    return rounded(prepare.dataset_stats(f.train, f.truth))


@query("loo_split", f"SELECT {ROW}, CASE WHEN back = 1 THEN 'test' ELSE 'train' END AS split FROM numbered WHERE n >= 3")
def _(f: Frames):
    return f.loo.select("user_id", "item_id", "k1", "k2", "k3", "split")


@query("loo_tail", f"SELECT {ROW}, CASE WHEN back = 1 THEN 'test' ELSE 'train' END AS split FROM numbered")
def _(f: Frames):
    return split.leave_one_out(f.pairs, 0).select("user_id", "item_id", "k1", "k2", "k3", "split")


_FIVE = "CASE WHEN n < 7 THEN 'train' WHEN back <= 5 THEN 'test' WHEN back = 6 THEN 'val' ELSE 'train' END"


@query("last5_val_split", f"SELECT {ROW}, {_FIVE} AS split FROM numbered")
def _(f: Frames):
    return split.last_five(f.pairs).select("user_id", "item_id", "k1", "k2", "k3", "split")


@query("loo_from_last5", "SELECT user_id, item_id FROM numbered WHERE n >= 7 AND back = 1")
def _(f: Frames):
    return split.last_of(split.last_five(f.pairs).where("split = 'test'")).select("user_id", "item_id")


@query("lastn_multipositive", "SELECT user_id, string_agg(item_id, ',' ORDER BY item_id) AS positives FROM mtruth GROUP BY user_id")
def _(f: Frames):
    return f.mtruth.groupBy("user_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("item_id"))).alias("positives"))


@query("heldout_label", "SELECT user_id, item_id AS label_item FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k1 DESC, k2 DESC, item_id DESC, k3 DESC) AS b FROM train) WHERE b = 1")
def _(f: Frames):
    return split.held_out_label(f.train)


_ASC = "PARTITION BY user_id ORDER BY ts, k1, k2, item_id, k3"


@query("seq_windows", f"""
SELECT user_id, position, target, array_to_string(input, ',') AS input FROM (
 SELECT user_id, item_id AS target, row_number() OVER ({_ASC}) AS position, list(item_id) OVER ({_ASC} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS input FROM train) WHERE position > 1""")
def _(f: Frames):
    return split.sequence_samples(f.train, 10).select("user_id", "position", "target", F.concat_ws(",", F.transform("input", lambda x: x.cast("string"))).alias("input"))


@query("seq_padded", f"""
SELECT user_id, position, repeat('0,', CAST(greatest(8 - len(input), 0) AS INTEGER)) || array_to_string(input[-8:], ',') AS input FROM (
 SELECT user_id, row_number() OVER ({_ASC}) AS position, list(item_id) OVER ({_ASC} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS input FROM train) WHERE position > 1""")
def _(f: Frames):
    padded = split.left_padded(F.col("input"), 8)
    return split.sequence_samples(f.train, 10).select("user_id", "position", F.concat_ws(",", F.transform(padded, lambda x: x.cast("string"))).alias("input"))


@query("history_tail", "SELECT user_id, item_id, back FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k1 DESC, k2 DESC, item_id DESC, k3 DESC) AS back FROM train) WHERE back <= 10")
def _(f: Frames):
    return split.history_tail(f.train)


@query("history_arrays", "SELECT user_id, string_agg(item_id, ',' ORDER BY ts, k1, k2, item_id, k3) AS history FROM train GROUP BY user_id")
def _(f: Frames):
    return split.histories(f.train).select("user_id", F.concat_ws(",", F.transform("history", lambda x: x.cast("string"))).alias("history"))


@query("pop_percentile", """
SELECT item_id, n, round(p, 6) AS pct, CAST(round(p * 99) AS BIGINT) AS pct_scaled FROM (
 SELECT item_id, n, (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2) / count(*) OVER () AS p FROM pop)""")
def _(f: Frames):
    return rounded(split.popularity_percentile(f.train))
