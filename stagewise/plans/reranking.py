"""Rerankers, fusion of orders, reply parsing, prompts and learning-to-rank frames."""

from __future__ import annotations

from stagewise.functions import parse
from stagewise.functions.lineage import kept
from stagewise.operators import prepare, rerank, split
from stagewise.plans.base import F, Frames, W, hash_sql, pair_hash_sql, query, rounded


def _order(order: str, cand: str = "cand", where: str = "rank <= 30") -> str:
    return f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rank, item_id FROM (SELECT * FROM {cand} WHERE {where})"


def _w(f: Frames):
    return f.cand.where("rank <= 30")


def histories(f: Frames):
    """user_id, item_id, back (1 is the last) from the stored rows of users."""
    return f.users.select("user_id", F.posexplode("own").alias("at", "item_id")).select("user_id", "item_id", (F.col("at") + 1).alias("back"))


def vector_candidates(f: Frames):
    """The shown candidates; those without a vector have no features of it."""
    return f.lists.select("user_id", F.explode(F.slice("list", 1, 30)).alias("x")).select("user_id", "x.item_id")


def _out(df):
    return df.select("user_id", "rank", "item_id")


@query("rerank_identity", _order("rank"))
def _(f: Frames):
    return _out(rerank.identity(_w(f)))


@query("rerank_score", _order("CASE WHEN item_id % 5 = 0 THEN -1e9 ELSE score END DESC, rank"))
def _(f: Frames):
    return _out(rerank.by_score(_w(f).withColumn("score", F.when(F.col("item_id") % 5 != 0, F.col("score")))))


@query("rerank_reverse", _order("rank DESC"))
def _(f: Frames):
    return _out(rerank.reverse(_w(f)))


@query("rerank_random", _order(f"{pair_hash_sql()}, item_id"))
def _(f: Frames):
    return _out(rerank.shuffled(_w(f)))


@query("rerank_popularity", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(n, 0) DESC, rank) AS rank, item_id FROM (SELECT * FROM cand WHERE rank <= 30) LEFT JOIN (SELECT item_id, count(*) AS n FROM mtrain GROUP BY item_id) USING (item_id)")
def _(f: Frames):
    return _out(rerank.by_popularity(_w(f), prepare.activity(f.mtrain, "item_id")))


@query("rerank_oracle", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY hit DESC, rank) AS rank, item_id FROM (SELECT c.*, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM mcand c LEFT JOIN mtruth t USING (user_id, item_id))")
def _(f: Frames):
    return _out(rerank.oracle(f.mcand, f.mtruth))


@query("rerank_jitter", _order(f"round(score + ({pair_hash_sql()} / 4294967296.0 - 0.5) * (0.01 * sqrt(12.0)), 12) DESC, rank"))
def _(f: Frames):
    return _out(rerank.jittered(_w(f)))


@query("rrf_orders", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY round(1 / (60 + place + 1) + 1 / (60 + new_place + 1), 12) DESC, place) AS rank, item_id FROM places")
def _(f: Frames):
    return _out(rerank.fused_with_places(f.places))


@query("convex_grid", """
SELECT user_id, weight_id, row_number() OVER (PARTITION BY user_id, weight_id ORDER BY round(weight_id * (1 - place / (n - 1)) + (1 - weight_id) * (1 - new_place / (n - 1)), 9) DESC, place) AS rank, item_id
FROM (SELECT p.*, count(*) OVER (PARTITION BY user_id) AS n, w.weight_id FROM places p, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) w(weight_id))""")
def _(f: Frames):
    grid = f.places.withColumn("w", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    return rerank.convex(grid, F.col("w"))


@query("rank_average", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY (place + new_place) / 2, place) AS rank, item_id FROM places")
def _(f: Frames):
    return _out(rerank.rank_average(f.places))


@query("scaled_weighted", """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY round(0.5 * a + 0.5 * b, 9) DESC, item_id) AS rank, item_id FROM (
 SELECT user_id, item_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE score END AS a, (29 - new_place - min(29 - new_place) OVER w) / (max(29 - new_place) OVER w - min(29 - new_place) OVER w) AS b FROM places WINDOW w AS (PARTITION BY user_id))""")
def _(f: Frames):
    return _out(rerank.scaled_sum(f.places.withColumn("other", (29 - F.col("new_place")).cast("double"))))


@query("route_rules", "SELECT user_id, item_id, CASE WHEN u.n < 20 OR u.n < 10 OR coalesce(p.n, 0) < 10 THEN 1 ELSE 0 END AS expert FROM (SELECT * FROM cand WHERE rank <= 30) JOIN (SELECT user_id, count(*) AS n FROM train GROUP BY user_id) u USING (user_id) LEFT JOIN pop p USING (item_id)")
def _(f: Frames):
    users = prepare.activity(f.train).select("user_id", F.col("n").alias("user_degree"), (F.col("n") < 20).alias("cold"))
    items = f.pop.select("item_id", F.col("n").alias("item_degree"))
    return rerank.route(_w(f).join(users, "user_id").join(items, "item_id", "left").fillna(0, ["item_degree"])).select("user_id", "item_id", "expert")


@query("cascade", f"SELECT c.user_id, c.rank, c.item_id FROM cand c JOIN (SELECT user_id, count(*) AS n FROM train GROUP BY user_id) u USING (user_id) WHERE c.rank <= 30 AND u.n > 30 UNION ALL SELECT r.user_id, r.rank, r.item_id FROM ({_order('rank DESC')}) r JOIN (SELECT user_id, count(*) AS n FROM train GROUP BY user_id) u USING (user_id) WHERE u.n <= 30")
def _(f: Frames):
    return _out(rerank.cascade(_w(f), rerank.reverse(_w(f)), prepare.activity(f.train), 30))


_POP = "coalesce(p.n, 0)"


@query("ltr_features5", f"SELECT user_id, item_id, rank, round(score, 6) AS f_score, round((rank - 1) / c.n, 6) AS f_place, round(ln(1 + {_POP}), 6) AS f_pop, round(ln(1 + coalesce(h.n, 0)), 6) AS f_hist, round(1 / rank, 6) AS f_recip FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM cand WHERE rank <= 30) c LEFT JOIN pop p USING (item_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM train GROUP BY user_id) h USING (user_id)")
def _(f: Frames):
    return rounded(rerank.features(_w(f), f.pop, f.train))


@query("ltr_vector_features", """
SELECT * FROM (WITH v AS (SELECT vec_id AS item_id, embedding FROM embeddings),
h AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k1 DESC, k2 DESC, item_id DESC, k3 DESC) AS back FROM train),
p AS (SELECT user_id, d, avg(CAST(embedding[d] AS DOUBLE)) AS u, coalesce(avg(CAST(embedding[d] AS DOUBLE)) FILTER (back <= 10), 0) AS l FROM h JOIN v USING (item_id), range(1, 65) r(d) GROUP BY user_id, d),
c AS (SELECT user_id, item_id FROM cand WHERE rank <= 30)
SELECT c.user_id, c.item_id, round(sum(p.u * CAST(embedding[p.d] AS DOUBLE)) / sqrt(sum(p.u * p.u)) / sqrt(sum(CAST(embedding[p.d] AS DOUBLE) ** 2)), 6) AS f_cos, round(sum(p.l * CAST(embedding[p.d] AS DOUBLE)), 6) AS f_late, round(sqrt(sum(CAST(embedding[p.d] AS DOUBLE) ** 2)), 6) AS f_norm
FROM c JOIN v USING (item_id) JOIN p ON p.user_id = c.user_id GROUP BY c.user_id, c.item_id)""")
def _(f: Frames):
    return rounded(rerank.vector_features(vector_candidates(f), histories(f), f.vectors))


@query("ltr_text_features", """
SELECT * FROM (WITH hist AS (SELECT user_id, item_id FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k1 DESC, k2 DESC, item_id DESC, k3 DESC) AS back FROM train) WHERE back <= 20),
words AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM item_text),
len AS (SELECT item_id, len(w) AS dl FROM words), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(w) AS term FROM words) GROUP BY item_id, term),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
qt AS (SELECT user_id, term, count(*) AS q FROM (SELECT h.user_id, unnest(w) AS term FROM hist h JOIN words USING (item_id)) GROUP BY user_id, term),
c AS (SELECT user_id, item_id FROM cand WHERE rank <= 30),
b AS (SELECT c.user_id, c.item_id, round(sum(q * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS s FROM c JOIN tf USING (item_id) JOIN idf USING (term) JOIN len USING (item_id) JOIN qt ON qt.user_id = c.user_id AND qt.term = tf.term, st GROUP BY c.user_id, c.item_id),
v AS (SELECT vec_id AS item_id, embedding FROM embeddings),
m AS (SELECT user_id, d, avg(CAST(embedding[d] AS DOUBLE)) AS x FROM hist JOIN v USING (item_id), range(1, 65) r(d) GROUP BY user_id, d),
u AS (SELECT user_id, d, x / (sqrt(sum(x * x) OVER (PARTITION BY user_id)) + 1e-9) AS x FROM m),
e AS (SELECT c.user_id, c.item_id, round(sum(u.x * CAST(v.embedding[u.d] AS DOUBLE)), 9) AS s FROM c JOIN v USING (item_id) JOIN u ON u.user_id = c.user_id GROUP BY c.user_id, c.item_id),
al AS (SELECT c.user_id, c.item_id, coalesce(b.s, 0) AS bm, coalesce(e.s, 0) AS de FROM c LEFT JOIN b USING (user_id, item_id) LEFT JOIN e USING (user_id, item_id))
SELECT user_id, item_id, round(bm, 6) AS f_bm25, round(de, 6) AS f_dense, round((row_number() OVER (PARTITION BY user_id ORDER BY bm DESC, item_id) - 1) / count(*) OVER (PARTITION BY user_id), 6) AS f_bm25_place, round((row_number() OVER (PARTITION BY user_id ORDER BY de DESC, item_id) - 1) / count(*) OVER (PARTITION BY user_id), 6) AS f_dense_place FROM al)""")
def _(f: Frames):
    return rounded(rerank.text_features(_w(f), histories(f).where("back <= 20"), f.item_text, f.vectors))


_GROUPS = "SELECT user_id, rank, item_id, label, group_size FROM groups"


def groups(f: Frames):
    return f.groups.select("user_id", "rank", "item_id", "label", "group_size")


def found_groups(f: Frames):
    """The groups that have a positive, stored: a few rows of the lists, read more than once."""
    return kept(f.labelled(f.found).select("user_id", "rank", "item_id", "label", "group_size"), "found-groups")


@query("ltr_groups", _GROUPS)
def _(f: Frames):
    return groups(f)


@query("ranknet_pairs", f"SELECT p.user_id, p.item_id AS positive, n.item_id AS negative, n.nth FROM ({_GROUPS}) p JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS nth FROM ({_GROUPS}) WHERE label = 0) n USING (user_id) WHERE p.label = 1 AND n.nth <= 5")
def _(f: Frames):
    return rerank.preference_pairs(found_groups(f))


_COSINE = """v AS (SELECT vec_id AS item_id, embedding FROM embeddings),
p AS (SELECT user_id, d, avg(CAST(embedding[d] AS DOUBLE)) AS u FROM train JOIN v USING (item_id), range(1, 65) r(d) GROUP BY user_id, d),
co AS (SELECT c.user_id, c.item_id, round(sum(p.u * CAST(embedding[p.d] AS DOUBLE)) / sqrt(sum(p.u * p.u)) / sqrt(sum(CAST(embedding[p.d] AS DOUBLE) ** 2)), 9) AS cosine FROM (SELECT * FROM cand WHERE rank <= 30) c JOIN v USING (item_id) JOIN p ON p.user_id = c.user_id GROUP BY c.user_id, c.item_id)"""


def cosines(f: Frames):
    """Cosine of each shown item with the mean vector of the user's history, where both have vectors."""
    return rerank.vector_features(vector_candidates(f), histories(f), f.vectors).select("user_id", "item_id", F.round("f_cos", 9).alias("cosine"))


@query("weighted_features", f"""
SELECT * FROM (WITH {_COSINE},
w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM item_text),
hw AS (SELECT user_id, list_distinct(flatten(list(w))) AS hw FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k1 DESC, k2 DESC, item_id DESC, k3 DESC) AS back FROM train) JOIN w USING (item_id) WHERE back <= 10 GROUP BY user_id)
SELECT c.user_id, row_number() OVER (PARTITION BY c.user_id ORDER BY round(0.4 * score + 0.3 * coalesce(co.cosine, 0) + 0.2 * coalesce(len(list_intersect(w.w, hw.hw)) / len(w.w), 0) + 0.1 * {_POP} / (SELECT max(n) FROM pop), 9) DESC, rank) AS rank, c.item_id
FROM (SELECT * FROM cand WHERE rank <= 30) c LEFT JOIN pop p USING (item_id) LEFT JOIN co USING (user_id, item_id) LEFT JOIN w USING (item_id) LEFT JOIN hw USING (user_id))""")
def _(f: Frames):
    from stagewise.operators.retrieve import tokens

    most = f.pop.agg(F.max("n").alias("most"))
    words = f.item_text.select("item_id", F.array_distinct(tokens(F.col("text"))).alias("w"))
    own = histories(f).where("back <= 10").join(words, "item_id").groupBy("user_id").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("hw"))
    rows = _w(f).join(f.pop, "item_id", "left").join(cosines(f), ["user_id", "item_id"], "left").join(words, "item_id", "left").join(own, "user_id", "left").join(F.broadcast(most))
    overlap = F.coalesce(F.size(F.array_intersect("w", "hw")) / F.nullif(F.size("w"), F.lit(0)), F.lit(0.0))
    return _out(rerank.weighted_features(rows.select("user_id", "item_id", "rank", "score", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), overlap.alias("overlap"), (F.coalesce("n", F.lit(0)) / F.col("most")).alias("pop"))))


@query("attention_smoothed", f"""
SELECT * FROM (WITH {_COSINE},
q AS (SELECT c.user_id, c.item_id, c.rank, CASE WHEN co.cosine IS NULL THEN 0 ELSE c.score END AS f1, coalesce(co.cosine, 0) AS f2, CASE WHEN co.cosine IS NULL THEN 0 ELSE ln(1 + {_POP}) END AS f3, CASE WHEN co.cosine IS NULL THEN 0 ELSE 1 / rank END AS f4, CASE WHEN co.cosine IS NULL THEN 0 ELSE (rank - 1) / count(*) OVER (PARTITION BY c.user_id) END AS f5
 FROM (SELECT * FROM cand WHERE rank <= 30) c LEFT JOIN co USING (user_id, item_id) LEFT JOIN pop p USING (item_id)),
z AS (SELECT a.user_id, a.item_id, a.rank, 0.4 * b.f1 + 0.3 * b.f2 + 0.2 * b.f3 + 0.1 * b.f4 AS y, (a.f1 * b.f1 + a.f2 * b.f2 + a.f3 * b.f3 + a.f4 * b.f4 + a.f5 * b.f5) / sqrt(5.0) AS z FROM q a JOIN q b ON a.user_id = b.user_id),
x AS (SELECT *, exp(z - max(z) OVER (PARTITION BY user_id, item_id)) AS a FROM z),
s AS (SELECT user_id, item_id, rank, round(sum(a * y) / (sum(a) + 1e-10), 9) AS s FROM x GROUP BY user_id, item_id, rank)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, rank) AS rank, item_id FROM s)""")
def _(f: Frames):
    # the lists stay arrays; only cosines, which few pairs have, are joined, by user
    found = cosines(f).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "cosine"))).alias("by_item"))
    own = f.lists.select("user_id", F.slice("list", 1, 30).alias("list")).join(found, "user_id", "left")
    cosine = F.transform("list", lambda x: F.element_at("by_item", x["item_id"]))
    cosine = F.when(F.col("by_item").isNull(), F.transform("list", lambda x: F.lit(None).cast("double"))).otherwise(cosine)
    return rerank.mixed_lists(own.select("user_id", F.col("list.item_id").alias("item_id"), F.col("list.score").alias("score"), cosine.alias("cosine"), F.transform("list", lambda x: x["pop"].cast("double")).alias("pop")))


_DRAWS = [f"({hash_sql('(user_id * 1000003 + item_id * 7919) % 2000000011', 42 + t)} / 4294967296.0::DOUBLE - 0.5) * sqrt(12.0::DOUBLE) * {0.1 * t / 5}" for t in range(1, 6)]
_NOISED = f"score + {1 / 5 * 2 / 5 * 3 / 5 * 4 / 5} * ({' + '.join(_DRAWS)})"


@query("denoised_scores", f"""
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(final, 9) DESC, rank) AS rank FROM (
 SELECT user_id, unnest(items) AS item_id, unnest(ranks) AS rank, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda done, x: list_append(done, x[1] + 0.05 * list_min(list_transform(done, lambda y: abs(x[1] - y)))))) AS final FROM (
  SELECT user_id, list(item_id ORDER BY rank) AS items, list(rank ORDER BY rank) AS ranks, list({_NOISED} ORDER BY rank) AS l FROM cand WHERE rank <= 30 GROUP BY user_id))""")
def _(f: Frames):
    return _out(rerank.denoised(_w(f)))


# replies ------------------------------------------------------------------------------

_ORDER_ = "SELECT user_id, string_agg(place, ',' ORDER BY new_place) AS order_ FROM places GROUP BY user_id"


def _text(c):
    return F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))


def _sized(f: Frames):
    return f.replies.join(_w(f).groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


@query("parse_positional", _ORDER_)
def _(f: Frames):
    return _sized(f).select("user_id", _text(parse.positions(F.col("reply"), F.col("n"))).alias("order_"))


def _parsed_sql(values: str) -> str:
    return f"""
SELECT * FROM (WITH v AS (SELECT user_id, list_filter(list_transform(list_filter({values}, lambda s: length(s) <= 9), lambda s: CAST(s AS INTEGER) - 1), lambda x: x >= 0 AND x < 30) AS x FROM replies),
f AS (SELECT user_id, place, min(pl) AS pl FROM (SELECT user_id, unnest(x) AS place, generate_subscripts(x, 1) AS pl FROM v) GROUP BY user_id, place)
SELECT r.user_id, string_agg(g.i, ',' ORDER BY f.pl NULLS LAST, g.i) AS order_ FROM replies r CROSS JOIN range(0, 30) g(i) LEFT JOIN f ON f.user_id = r.user_id AND f.place = g.i GROUP BY r.user_id)"""


_CLEAN = "regexp_replace(reply, '(?s)<think>.*?</think>', '', 'g')"


@query("parse_mixed", _parsed_sql(f"CASE WHEN len(regexp_extract_all({_CLEAN}, '(?m)^\\s*#?([0-9]+)[.):]?', 1)) > 0 THEN regexp_extract_all({_CLEAN}, '(?m)^\\s*#?([0-9]+)[.):]?', 1) ELSE regexp_extract_all({_CLEAN}, '[0-9]+') END"))
def _(f: Frames):
    return f.replies.select("user_id", _text(parse.positions_from_lines(F.col("reply"), F.lit(30))).alias("order_"))


@query("parse_commas", _parsed_sql("list_filter(list_transform(string_split(reply, ','), lambda s: trim(s)), lambda s: regexp_full_match(s, '[0-9]+'))"))
def _(f: Frames):
    return f.replies.select("user_id", _text(parse.positions_from_commas(F.col("reply"), F.lit(30))).alias("order_"))


@query("parse_ids", """
SELECT * FROM (WITH c AS (SELECT user_id, rank, item_id FROM cand WHERE rank <= 10),
t AS (SELECT user_id, 'Item ' || max(item_id) FILTER (rank = 3) || ', then #' || max(item_id) FILTER (rank = 7) || ' and ID: ' || max(item_id) FILTER (rank = 2) || ', item 999999' AS reply FROM c GROUP BY user_id)
SELECT user_id, string_agg(item_id, ',' ORDER BY CASE rank WHEN 3 THEN -3 WHEN 7 THEN -2 WHEN 2 THEN -1 ELSE rank END) AS ids FROM c GROUP BY user_id)""")
def _(f: Frames):
    g = f.cand.where("rank <= 10").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("r")).select("user_id", F.transform("r", lambda x: x["item_id"]).alias("c"))
    reply = F.concat(F.lit("Item "), F.col("c")[2].cast("string"), F.lit(", then #"), F.col("c")[6].cast("string"), F.lit(" and ID: "), F.col("c")[1].cast("string"), F.lit(", item 999999"))
    return g.select("user_id", _text(parse.item_ids(reply, F.col("c"), 10)).alias("ids"))


@query("parse_status", f"SELECT user_id, k AS found, CASE WHEN user_id % 50 = 7 THEN 'api_timeout' WHEN k = 0 THEN 'parse_empty' WHEN k < 3 THEN 'degenerate' WHEN k < 10 THEN 'short' ELSE 'ok' END AS status FROM (SELECT user_id, len(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all({_CLEAN}, '[0-9]+'), lambda s: length(s) <= 9), lambda s: CAST(s AS INTEGER)), lambda v: v >= 1 AND v <= 30))) AS k FROM replies)")
def _(f: Frames):
    found = parse.numbers_found(F.col("reply"), F.lit(30)).cast("long")
    rows = f.replies.select("user_id", "reply", found.alias("found"))
    return rows.select("user_id", "found", parse.status(F.col("reply"), F.col("found"), F.when(F.col("user_id") % 50 == 7, "timeout")).alias("status"))


@query("apply_permutation", "SELECT c.user_id, coalesce(p.new_place + 1, c.rank) AS rank, c.item_id FROM cand c LEFT JOIN places p USING (user_id, item_id)")
def _(f: Frames):
    orders = _sized(f).select("user_id", parse.positions(F.col("reply"), F.col("n")).alias("order"))
    return _out(parse.apply_order(f.cand, orders, 30))


# prompts ------------------------------------------------------------------------------

_HIST = "SELECT t.user_id, row_number() OVER (PARTITION BY t.user_id ORDER BY back DESC) AS pl, x.text FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k1 DESC, k2 DESC, item_id DESC, k3 DESC) AS back FROM train) t JOIN item_text x USING (item_id) WHERE back <= 10"


def _prompt_sql(tail: str) -> str:
    return f"""
SELECT c.user_id, 'The user chose:' || chr(10) || coalesce(h.h, '') || chr(10) || chr(10) || 'Candidates:' || chr(10) || c.c || chr(10) || chr(10) || '{tail}' AS prompt
FROM (SELECT user_id, string_agg(rank || '. ' || substring(text, 1, 60), chr(10) ORDER BY rank) AS c FROM cand JOIN item_text USING (item_id) WHERE rank <= 30 GROUP BY user_id) c
LEFT JOIN (SELECT user_id, string_agg(pl || '. ' || substring(text, 1, 60), chr(10) ORDER BY pl) AS h FROM ({_HIST}) GROUP BY user_id) h USING (user_id)"""


def history_lines(f: Frames):
    w = W.partitionBy("user_id").orderBy(F.desc("back"))
    return split.history_tail(f.train).withColumn("at", F.row_number().over(w)).join(f.item_text, "item_id")


def _sql_text(s: str) -> str:
    return s.replace("'", "''").replace("\n", "' || chr(10) || '")


def _register(family: str, tail: str) -> None:
    @query(f"prompt_{family}", _prompt_sql(_sql_text(tail)))
    def _(f: Frames):
        return parse.plain_prompt(history_lines(f), _w(f).join(f.item_text, "item_id"), family)


for _family, _tail in parse.TEMPLATES.items():
    _register(_family, _tail)


@query("prompt_scoreaware", """
SELECT user_id, string_agg(rank || '. ' || substring(text, 1, 60) || ' [rank ' || rank || ', score ' || printf('%.2f', round(s, 4) + 1e-9) || ', popularity ' || pct || '%]', chr(10) ORDER BY rank) AS candidates FROM (
 SELECT c.user_id, c.rank, x.text, CAST(round(q.p * 99) AS BIGINT) AS pct, (score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0) AS s FROM cand c JOIN item_text x USING (item_id)
 JOIN (SELECT item_id, (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2) / count(*) OVER () AS p FROM pop) q USING (item_id) WHERE c.rank <= 30 WINDOW w AS (PARTITION BY c.user_id)) WHERE s IS NOT NULL GROUP BY user_id""")
def _(f: Frames):
    w = W.partitionBy("user_id")
    s = (F.col("score") - F.min("score").over(w)) / F.nullif(F.max("score").over(w) - F.min("score").over(w), F.lit(0.0))
    pct = split.popularity_percentile(f.train).select("item_id", F.col("pct_scaled").alias("pct"))
    shown = _w(f).withColumn("score", F.round(s, 4)).join(f.item_text, "item_id").join(pct, "item_id").where("score is not null")
    return parse.score_aware_lines(shown)


@query("sft_examples", f"""
SELECT g.user_id, g.item_id, g.label, 'The user chose: ' || h.h || chr(10) || 'Will the user choose "' || x.text || '"? Answer yes or no.' AS prompt, CASE WHEN g.label = 1 THEN 'yes' ELSE 'no' END AS answer
FROM (SELECT user_id, item_id, label FROM (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY rank) AS nth, max(label) OVER (PARTITION BY user_id) AS any_ FROM ({_GROUPS})) WHERE any_ = 1 AND (label = 1 OR nth <= 5)) g
JOIN (SELECT user_id, string_agg(text, ', ' ORDER BY back DESC) AS h FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k1 DESC, k2 DESC, item_id DESC, k3 DESC) AS back FROM mtrain) JOIN item_text USING (item_id) WHERE back BETWEEN 2 AND 6 GROUP BY user_id) h USING (user_id)
JOIN item_text x USING (item_id)""")
def _(f: Frames):
    w = W.partitionBy("user_id", "label").orderBy("rank")
    rows = found_groups(f).withColumn("nth", F.row_number().over(w)).where("label = 1 or nth <= 5")
    # the last training item is the label: the five before it are shown
    shown = f.found.select("user_id", F.posexplode(F.slice("own", 1, 5)).alias("back", "item_id"))
    g = shown.join(f.item_text, "item_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("b"), "text"))).alias("h"))
    history = g.select("user_id", F.array_join(F.transform("h", lambda x: x["text"]), ", ").alias("history"))
    rows = rows.join(history, "user_id").join(f.item_text, "item_id")
    return rows.select("user_id", "item_id", "label", parse.pointwise_prompt(F.col("history"), F.col("text")).alias("prompt"), F.when(F.col("label") == 1, "yes").otherwise("no").alias("answer"))


_GATE = ((0.3, 1.0, -0.5), (0.2, -2.0, 0.1), (-0.4, 0.5, 1.0), (0.1, 0.1, 0.1))
_LOGITS = ", ".join(f"{a} * ln(n_hist) + {b} * a + {c}" for a, b, c in _GATE)


@query("gate_topk", f"""
SELECT user_id, expert, nth, round(p / sum(p) OVER (PARTITION BY user_id), 6) AS weight FROM (
 SELECT user_id, expert, p, row_number() OVER (PARTITION BY user_id ORDER BY round(p, 12) DESC, expert) AS nth FROM (
  SELECT user_id, generate_subscripts(z, 1) - 1 AS expert, exp(unnest(z)) AS p FROM (SELECT user_id, [{_LOGITS}] AS z FROM two_arms))) WHERE nth <= 2""")
def _(f: Frames):
    """Two of four experts a user and their weights, by a given gate on activity and NDCG."""
    from stagewise.operators import gate

    rows = f.two_arms.select("user_id", F.array(F.log("n_hist"), "a").alias("x"))
    routed = gate.route(rows, "x", gate.Gate(_GATE), 2)
    return rounded(routed.select("user_id", F.posexplode(F.arrays_zip("experts", "weights")).alias("at", "r")).select("user_id", F.col("r.experts").alias("expert"), (F.col("at") + 1).alias("nth"), F.col("r.weights").alias("weight")))


@query("gate_trained")
def _(f: Frames):
    """Usage of two rankings under a gate that learned from activity which of them serves a user better (learned: no SQL)."""
    from stagewise.operators import gate

    rows = f.two_arms.select("user_id", F.array(F.log("n_hist")).alias("x"), F.array("a", "b").alias("y"))
    learned, _ = gate.train_gate(rows, "x", "y", steps=10, rate=2.0, balance=0.05)
    return rounded(gate.usage_entropy(gate.route(rows, "x", learned, 1)), 3)
