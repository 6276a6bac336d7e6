"""Candidate retrieval and fusion."""

from __future__ import annotations

from stagewise.operators import neighbours, prepare, retrieve
from stagewise.plans.base import ORDER, F, Frames, W, pair_hash_sql, query, rounded


def _ranked(inner: str, k: int, score: str = "score") -> str:
    """Top k of a statement with user_id, item_id, score."""
    return f"SELECT user_id, rank, item_id, round({score}, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM ({inner})) WHERE rank <= {k}"


_UNSEEN = "NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = s.user_id AND t.item_id = s.item_id)"


@query("pop_topk", "SELECT user_id, rank, item_id, round(score, 6) AS score FROM cand")
def _(f: Frames):
    return rounded(f.cand)


@query("random_topk", _ranked(f"SELECT * FROM (SELECT u.user_id, i.item_id, {pair_hash_sql(42, 'u.user_id', 'i.item_id')} / 4294967296.0 AS score FROM (SELECT DISTINCT user_id FROM train) u, (SELECT DISTINCT item_id FROM train) i) s WHERE {_UNSEEN}", 20))
def _(f: Frames):
    return rounded(retrieve.random_items(f.train, 20, own=f.users))


_SIM = "sim AS (SELECT a.item_id AS i, b.item_id AS j, count(*) / sqrt(any_value(x.n) * any_value(y.n)) AS sim FROM train a JOIN train b ON a.user_id = b.user_id AND a.item_id <> b.item_id JOIN pop x ON x.item_id = a.item_id JOIN pop y ON y.item_id = b.item_id GROUP BY a.item_id, b.item_id)"
_KNN = "SELECT s.* FROM (SELECT t.user_id, s.j AS item_id, round(sum(s.sim), 9) AS score FROM train t JOIN {sim} s ON s.i = t.item_id GROUP BY t.user_id, s.j) s WHERE " + _UNSEEN


@query("itemknn_full", f"SELECT * FROM (WITH {_SIM} {_ranked(_KNN.format(sim='sim'), 20)})")
def _(f: Frames):
    return rounded(neighbours.all_neighbours(f.spark, t, 20) if (t := f.meetings) else retrieve.item_knn(f.train, 20))


def nearest50(f: Frames):
    return neighbours.listed(f.spark, t, 20, 50) if (t := f.meetings) else retrieve.item_knn(f.train, 20, neighbours=50)


@query("itemknn_top50", f"SELECT * FROM (WITH {_SIM}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j) AS nth FROM sim) WHERE nth <= 50) {_ranked(_KNN.format(sim='near'), 20)})")
def _(f: Frames):
    return rounded(nearest50(f))


@query("itemknn_profile", f"""
SELECT * FROM (WITH unit AS (SELECT t.user_id, t.item_id, 1 / sqrt(p.n) AS w FROM train t JOIN pop p USING (item_id)),
profile AS (SELECT t.user_id AS who, u.user_id, CAST(sum(CAST(round(u.w * 1e12) AS BIGINT)) AS DOUBLE) / 1e12 AS p FROM train t JOIN unit u USING (item_id) GROUP BY t.user_id, u.user_id),
size AS (SELECT who, sqrt(CAST(sum(CAST(p * p AS DECIMAL(28,12))) AS DOUBLE)) AS length FROM profile GROUP BY who),
dots AS (SELECT who, item_id, CAST(sum(CAST(round(p * w * 1e12) AS BIGINT)) AS DOUBLE) / 1e12 AS dot FROM profile JOIN unit USING (user_id) GROUP BY who, item_id)
{_ranked(f"SELECT * FROM (SELECT d.who AS user_id, d.item_id, round(d.dot / z.length, 9) AS score FROM dots d JOIN size z USING (who)) s WHERE {_UNSEEN}", 20)})""")
def _(f: Frames):
    return rounded(neighbours.profiles(f.spark, t, 20) if (t := f.meetings) else retrieve.profile_knn(f.train, 20))


@query("cooc_window", f"""
SELECT * FROM (WITH pos AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, k1, k2, item_id, k3) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k1 DESC, k2 DESC, item_id DESC, k3 DESC) AS back FROM train),
c AS (SELECT a.item_id AS i, b.item_id AS j, count(*) AS c FROM pos a JOIN pos b ON a.user_id = b.user_id AND abs(a.p - b.p) <= 10 AND a.p <> b.p AND a.item_id <> b.item_id GROUP BY a.item_id, b.item_id),
s2 AS (SELECT i, j, c / sum(c) OVER (PARTITION BY i) AS sim FROM c)
{_ranked(f"SELECT * FROM (SELECT o.user_id, x.j AS item_id, round(sum(x.sim), 9) AS score FROM pos o JOIN s2 x ON x.i = o.item_id WHERE o.back <= 20 GROUP BY o.user_id, x.j) s WHERE {_UNSEEN}", 20)})""")
def _(f: Frames):
    return rounded(neighbours.windows(f.spark, t, 20) if (t := f.meetings) else retrieve.cooccurrence_recall(f.train, ORDER, 20))


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query("bm25_parts", f"""
SELECT * FROM (WITH words AS (SELECT item_id, {_TOKENS} AS w FROM item_text),
len AS (SELECT item_id, len(w) AS dl FROM words), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(w) AS term FROM words) GROUP BY item_id, term),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT p_partkey AS query_id, unnest(regexp_extract_all(lower(p_name || ' ' || p_name || ' ' || p_type), '[a-z0-9]+')) AS term FROM part WHERE p_partkey % 50 = 0),
qt AS (SELECT query_id, term, count(*) AS q FROM q GROUP BY query_id, term)
SELECT query_id, item_id, round(sum(q * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN len USING (item_id), st GROUP BY query_id, item_id)""")
def _(f: Frames):
    # the stated query set of searches: ids divisible by 50, against all items
    asked = f.table("part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_name", "p_type").alias("text"))
    return rounded(retrieve.bm25(f.item_text, asked))


@query("tfidf_blend", f"""
SELECT * FROM (WITH tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM item_text) GROUP BY item_id, term),
voc AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 500),
w AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM item_text)) / (1 + df)) + 1) AS w FROM tf JOIN voc USING (term)),
v AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM w),
h AS (SELECT user_id, count(*) AS n FROM train GROUP BY user_id),
profile AS (SELECT t.user_id, v.term, sum(v.weight) / any_value(h.n) AS p FROM train t JOIN v USING (item_id) JOIN h USING (user_id) GROUP BY t.user_id, v.term),
size AS (SELECT user_id, sqrt(CAST(sum(CAST(p * p AS DECIMAL(28,12))) AS DOUBLE)) AS length FROM profile GROUP BY user_id),
d AS (SELECT c.user_id, c.item_id, sum(v.weight * p.p) AS dot FROM cand c JOIN v USING (item_id) JOIN profile p ON p.user_id = c.user_id AND p.term = v.term GROUP BY c.user_id, c.item_id)
{_ranked("SELECT c.user_id, c.item_id, round(0.7 * c.score + 0.3 * coalesce(d.dot / nullif(z.length, 0), 0), 9) AS score FROM cand c LEFT JOIN d USING (user_id, item_id) LEFT JOIN size z USING (user_id)", 20)})""")
def _(f: Frames):
    return rounded(retrieve.text_blend(f.cand, f.rows, retrieve.tf_idf(f.item_text), 20))


@query("dense_docs", """
SELECT * FROM (WITH g AS (SELECT label AS user_id, vec_id AS item_id FROM embeddings),
parts AS (SELECT g.user_id, i AS d, avg(CAST(e.embedding[i] AS DOUBLE)) AS x FROM g JOIN embeddings e ON e.vec_id = g.item_id, range(1, 65) r(i) GROUP BY g.user_id, i),
norm AS (SELECT user_id, d, x / sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS x FROM parts),
s AS (SELECT n.user_id, e.vec_id AS item_id, round(sum(n.x * CAST(e.embedding[n.d] AS DOUBLE)), 9) AS score FROM norm n, embeddings e GROUP BY n.user_id, e.vec_id)
SELECT user_id, rank, item_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM g)) WHERE rank <= 10)""")
def _(f: Frames):
    e = f.table("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("user_id"))
    return rounded(retrieve.dense(e.select("item_id", "vector"), e.select("user_id", "item_id"), 10))


@query("multi_interest_scores", """
SELECT * FROM (WITH s AS (SELECT u.label AS user_id, i.vec_id AS item_id, max(round((SELECT sum(CAST(u.embedding[d] AS DOUBLE) * CAST(i.embedding[d] AS DOUBLE)) FROM range(1, 65) r(d)), 9)) AS score FROM embeddings u, embeddings i GROUP BY u.label, i.vec_id)
SELECT user_id, rank, item_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 10)""")
def _(f: Frames):
    e = f.table("embeddings")
    interests = e.select(F.col("label").cast("long").alias("user_id"), F.col("embedding").alias("interest"))
    return rounded(retrieve.from_interests(interests, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 10))


@query("markov_next", f"""
SELECT * FROM (WITH o AS (SELECT user_id, item_id, lead(item_id) OVER (PARTITION BY user_id ORDER BY ts, k1, k2, item_id, k3) AS nx, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k1 DESC, k2 DESC, item_id DESC, k3 DESC) AS back FROM train),
m AS (SELECT item_id AS i, nx AS j, count(*) AS c FROM o WHERE nx IS NOT NULL GROUP BY item_id, nx)
{_ranked(f"SELECT * FROM (SELECT o.user_id, m.j AS item_id, CAST(m.c AS DOUBLE) AS score FROM o JOIN m ON m.i = o.item_id WHERE o.back = 1) s WHERE {_UNSEEN}", 20)})""")
def _(f: Frames):
    return rounded(retrieve.transitions(f.train, ORDER, 20))


# a second and a third list: popularity of small items, and hash order
CAND2 = f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY {pair_hash_sql(7)}, item_id) AS rank, item_id, 1.0 - {pair_hash_sql(7)} / 4294967296.0 AS score FROM cand WHERE item_id % 2 = 0"


def second(f: Frames):
    w = W.partitionBy("user_id").orderBy("h", "item_id")
    from stagewise.functions.arith import pair_hash32

    rows = f.cand.where("item_id % 2 = 0").withColumn("h", pair_hash32("user_id", "item_id", 7))
    return rows.select("user_id", F.row_number().over(w).alias("rank"), "item_id", (1 - F.col("h") / F.lit(4294967296.0)).alias("score"))


@query("weighted_hybrid", f"SELECT * FROM (WITH c2 AS ({CAND2}) {_ranked('SELECT user_id, item_id, round(sum(score), 9) AS score FROM (SELECT user_id, item_id, 0.5 * score AS score FROM cand UNION ALL SELECT user_id, item_id, 0.5 * score FROM c2) GROUP BY user_id, item_id', 50)})")
def _(f: Frames):
    return rounded(retrieve.weighted(f.cand, second(f), 50))


@query("score_average_hybrid", f"""
SELECT * FROM (WITH c2 AS ({CAND2}),
n1 AS (SELECT user_id, item_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE score END AS score FROM cand WINDOW w AS (PARTITION BY user_id)),
n2 AS (SELECT user_id, item_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE score END AS score FROM c2 WINDOW w AS (PARTITION BY user_id))
{_ranked('SELECT user_id, item_id, round(sum(score), 9) AS score FROM (SELECT user_id, item_id, 0.5 * score AS score FROM n1 UNION ALL SELECT user_id, item_id, 0.5 * score FROM n2) GROUP BY user_id, item_id', 50)})""")
def _(f: Frames):
    return rounded(retrieve.weighted(retrieve.min_max(f.cand), retrieve.min_max(second(f)), 50))


@query("full_score_average", f"""
SELECT * FROM (WITH {_SIM}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j) AS nth FROM sim) WHERE nth <= 50),
a AS (SELECT t.user_id, s.j AS item_id, round(sum(s.sim), 9) AS s FROM train t JOIN near s ON s.i = t.item_id GROUP BY t.user_id, s.j),
pos AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, k1, k2, item_id, k3) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k1 DESC, k2 DESC, item_id DESC, k3 DESC) AS back FROM train),
c AS (SELECT x.item_id AS i, y.item_id AS j, count(*) AS c FROM pos x JOIN pos y ON x.user_id = y.user_id AND abs(x.p - y.p) <= 10 AND x.p <> y.p GROUP BY x.item_id, y.item_id),
s2 AS (SELECT i, j, c / sum(c) OVER (PARTITION BY i) AS sim FROM c),
b AS (SELECT o.user_id, x.j AS item_id, round(sum(x.sim), 9) AS s FROM pos o JOIN s2 x ON x.i = o.item_id WHERE o.back <= 20 GROUP BY o.user_id, x.j),
al AS (SELECT user_id, item_id, coalesce(a.s, 0) AS a, coalesce(b.s, 0) AS b FROM a FULL JOIN b USING (user_id, item_id)),
n AS (SELECT count(DISTINCT item_id) AS n FROM train),
ra AS (SELECT user_id, CASE WHEN count(*) < n THEN least(min(s), 0) ELSE min(s) END AS lo, CASE WHEN count(*) < n THEN greatest(max(s), 0) ELSE max(s) END AS hi FROM a, n GROUP BY user_id, n),
rb AS (SELECT user_id, CASE WHEN count(*) < n THEN least(min(s), 0) ELSE min(s) END AS lo, CASE WHEN count(*) < n THEN greatest(max(s), 0) ELSE max(s) END AS hi FROM b, n GROUP BY user_id, n)
{_ranked(f"SELECT s.* FROM (SELECT al.user_id, al.item_id, round(0.5 * (a - ra.lo) / (ra.hi - ra.lo + 1e-8) + 0.5 * (b - rb.lo) / (rb.hi - rb.lo + 1e-8), 9) AS score FROM al JOIN ra USING (user_id) JOIN rb USING (user_id)) s WHERE {_UNSEEN}", 20)})""")
def _(f: Frames):
    found = neighbours.averaged(f.spark, t, 20, 50) if (t := f.meetings) else None
    return rounded(found if found is not None else retrieve.full_average(retrieve.knn_scores(f.train), retrieve.cooccurrence_scores(f.train, ORDER), f.train, 20))


@query("max_scaled", f"SELECT user_id, rank, item_id, round(score / CASE WHEN max(score) OVER (PARTITION BY user_id) > 0 THEN max(score) OVER (PARTITION BY user_id) ELSE 1 END, 6) AS score FROM ({CAND2})")
def _(f: Frames):
    return rounded(retrieve.max_scaled(second(f)))


@query("knn_minmax", f"SELECT * FROM (WITH {_SIM}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j) AS nth FROM sim) WHERE nth <= 50), r AS ({_ranked(_KNN.format(sim='near'), 20)}) SELECT user_id, item_id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE score END, 5) AS score FROM r WINDOW w AS (PARTITION BY user_id))")
def _(f: Frames):
    return rounded(retrieve.min_max(rounded(nearest50(f))), 5).select("user_id", "item_id", "score")


@query("vote_hybrid", f"SELECT * FROM (WITH c2 AS ({CAND2}) {_ranked('SELECT user_id, item_id, round(sum(v), 9) AS score FROM (SELECT user_id, item_id, 0.6 AS v FROM cand UNION ALL SELECT user_id, item_id, 0.4 FROM c2) GROUP BY user_id, item_id', 50)})")
def _(f: Frames):
    return rounded(retrieve.votes(f.cand, second(f), 50))


@query("quota_hybrid", f"""
SELECT * FROM (WITH c2 AS ({CAND2}),
al AS (SELECT user_id, item_id, 0 AS source, rank FROM c2 WHERE rank <= 30 UNION ALL SELECT user_id, item_id, 1, rank FROM cand UNION ALL SELECT user_id, item_id, 2, rank FROM cand),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY source, rank) AS nth FROM al) WHERE nth = 1),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, source ORDER BY rank) AS pl FROM one) WHERE source <> 1 OR pl <= 20),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source, rank, item_id) AS place FROM cut)
SELECT user_id, place AS rank, item_id, round(1 / place, 6) AS score FROM f WHERE place <= 50)""")
def _(f: Frames):
    return rounded(retrieve.quota(second(f), f.cand, f.cand, 50))


def _rrf(lists: list[str], k: int) -> str:
    union = " UNION ALL ".join(f"SELECT user_id, item_id, rank FROM {x}" for x in lists)
    return _ranked(f"SELECT user_id, item_id, round(sum(1 / (60 + rank)), 12) AS score FROM ({union}) GROUP BY user_id, item_id", k)


@query("rrf_2way", f"SELECT * FROM (WITH c2 AS ({CAND2}) {_rrf(['cand', 'c2'], 50)})")
def _(f: Frames):
    return rounded(retrieve.reciprocal_ranks([f.cand, second(f)], 50))


@query("rrf_3way", f"SELECT * FROM (WITH c2 AS ({CAND2}), c3 AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rank DESC) AS rank FROM cand) {_rrf(['cand', 'c2', 'c3'], 50)})")
def _(f: Frames):
    w = W.partitionBy("user_id").orderBy(F.desc("rank"))
    back = f.cand.withColumn("rank", F.row_number().over(w))
    return rounded(retrieve.reciprocal_ranks([f.cand, second(f), back], 50))


@query("popularity_fallback", "SELECT c.user_id, c.rank, c.item_id, round(CASE WHEN c.user_id % 2 = 0 THEN 1.0 ELSE c.score END, 6) AS score FROM cand c WHERE c.rank <= 10")
def _(f: Frames):
    known = f.cand.where("rank <= 10 and user_id % 2 = 0").withColumn("score", F.lit(1.0))
    return rounded(retrieve.with_fallback(known, f.train.select("user_id").distinct(), f.cand.where("rank <= 10")))


@query("hybrid_union", f"SELECT user_id, item_id FROM cand UNION SELECT user_id, item_id FROM ({CAND2})")
def _(f: Frames):
    return f.cand.select("user_id", "item_id").union(second(f).select("user_id", "item_id")).distinct()


@query("catalog_rank", "SELECT item_id, n FROM pop ORDER BY n DESC, item_id LIMIT 100")
def _(f: Frames):
    return prepare.activity(f.train, "item_id").orderBy(F.desc("n"), "item_id").limit(100)


