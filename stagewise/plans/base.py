"""The frames that queries share, their SQL twins, and the registry of queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagewise.functions import metrics
from stagewise.functions.arith import binary_round, hash32
from stagewise.functions.lineage import kept
from stagewise.operators import neighbours, prepare, rerank, retrieve, split

ORDER = prepare.ORDER


class Frames:
    """Lazy frames over the tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def inter(self) -> DataFrame:
        return prepare.interactions(self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate"), self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))

    @cached_property
    def pairs(self) -> DataFrame:
        return prepare.keep_first(self.inter)

    @cached_property
    def loo(self) -> DataFrame:
        return split.leave_one_out(self.pairs)

    @cached_property
    def train(self) -> DataFrame:
        return self.loo.where("split = 'train'").drop("split")

    @cached_property
    def truth(self) -> DataFrame:
        return self.loo.where("split = 'test'").select("user_id", "item_id")

    @cached_property
    def multi(self) -> DataFrame:
        return split.last_n_positives(self.pairs, 5)

    @cached_property
    def mtrain(self) -> DataFrame:
        return self.multi.where("split = 'train'").drop("split")

    @cached_property
    def mtruth(self) -> DataFrame:
        return self.multi.where("split = 'test'").select("user_id", "item_id")

    @cached_property
    def met(self) -> DataFrame:
        """user_id, items: a row a user, the last item first; stored, so that the log is joined and sorted once a query."""
        return kept(split.met_items(self.inter), "met")

    @cached_property
    def users(self) -> DataFrame:
        """user_id, own, truth: training and test items of ``loo``."""
        return self.met.where(F.size("items") >= 3).select("user_id", F.slice("items", F.lit(2), F.size("items") - 1).alias("own"), F.slice("items", 1, 1).alias("truth"))

    @cached_property
    def rows(self) -> DataFrame:
        """user_id, item_id of the training items, from the stored rows of users."""
        return self.users.select("user_id", F.explode("own").alias("item_id"))

    @cached_property
    def meetings(self) -> neighbours.Table | None:
        """The training items of all users in the driver's memory, or None where they are too many."""
        return neighbours.table(self.users.select("user_id", F.col("own").alias("items")))

    @cached_property
    def musers(self) -> DataFrame:
        """user_id, own, truth, half, n_history of ``multi``; users of half "a" are evaluated, of "b" models learn."""
        rows = self.met.where(F.size("items") > 7).select("user_id", F.slice("items", F.lit(6), F.size("items") - 5).alias("own"), F.slice("items", 1, 5).alias("truth"))
        last = kept(prepare.first_half(rows.select("user_id")), "half")
        key = F.struct(hash32("user_id").alias("h"), F.col("user_id").alias("user_id"))
        return rows.join(F.broadcast(last)).select("user_id", "own", "truth", F.when(key <= F.col("last"), "a").otherwise("b").alias("half"), F.size("own").cast("long").alias("n_history"))

    @staticmethod
    def counts(users: DataFrame) -> DataFrame:
        return users.select(F.explode("own").alias("item_id")).groupBy("item_id").agg(F.count("*").alias("n"))

    @cached_property
    def lists(self) -> DataFrame:
        """The rows of ``users`` with their 100 candidates as an array, dealt by user before there are a hundred rows of each."""
        return retrieve.popular_lists(self.users.repartition("user_id"), self.pop, 100)

    def mlists(self, users: DataFrame, k: int = 100) -> DataFrame:
        """Some rows of ``musers``, or of ``pool``, with their candidates as an array."""
        return retrieve.popular_lists(users, self.mpop, k)

    @cached_property
    def cand(self) -> DataFrame:
        return retrieve.unrolled(self.lists)

    @cached_property
    def mcand(self) -> DataFrame:
        return retrieve.unrolled(self.mlists(self.musers.repartition("user_id")))

    @cached_property
    def mcand101(self) -> DataFrame:
        return retrieve.unrolled(self.mlists(self.musers.repartition("user_id"), 101))

    @cached_property
    def halves(self) -> DataFrame:
        """user_id, half, n_history of all users that can be evaluated."""
        return self.musers.select("user_id", "half", "n_history")

    @cached_property
    def pool(self) -> DataFrame:
        """user_id, own, label_item, n_history, list: users that aren't evaluated, their last training item as the label, and candidates that may have it."""
        b = self.musers.where("half = 'b' and n_history >= 4")
        return self.mlists(b.select("user_id", F.slice("own", F.lit(2), F.size("own") - 1).alias("own"), F.element_at("own", 1).alias("label_item"), "n_history"))

    @cached_property
    def found(self) -> DataFrame:
        """The rows of ``pool`` whose list has the label: others have no pair of a positive and a negative."""
        return self.pool.where(F.exists("list", lambda x: x["item_id"] == F.col("label_item")))

    @cached_property
    def groups(self) -> DataFrame:
        """Groups of users that aren't evaluated, labelled by their last training item."""
        return self.labelled(self.pool)

    @staticmethod
    def labelled(pool: DataFrame) -> DataFrame:
        rows = retrieve.unrolled(pool, "label_item", "n")
        return rows.select("user_id", "rank", "item_id", (F.col("item_id") == F.col("label_item")).cast("int").alias("label"), F.col("n").cast("long").alias("group_size"), "score")

    @cached_property
    def mpop(self) -> DataFrame:
        return kept(self.counts(self.musers), "mpop")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))

    @cached_property
    def mu(self) -> DataFrame:
        return metrics.per_user(self.mcand, self.mtruth)

    @cached_property
    def pop(self) -> DataFrame:
        return kept(self.counts(self.users), "pop")

    @cached_property
    def item_text(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("item_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))

    @cached_property
    def replies(self) -> DataFrame:
        """user_id, reply: strings in place of model replies, by arithmetic, with the faults replies have."""
        u = F.col("user_id")
        step = F.pmod(u * 7, F.lit(11)) + 1
        numbers = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: (F.pmod(u * 5 + i * step, F.lit(34)) + 1).cast("string"))
        reply = F.when(u % 10 == 0, "").when(u % 10 == 1, "I can't rank these.").when(u % 10 == 2, F.concat(F.lit("<think>1 2 3</think>"), F.array_join(numbers, ", ")))
        reply = reply.when(u % 10 == 3, F.array_join(F.slice(numbers, 1, 2), ",")).when(u % 10 == 4, F.array_join(F.transform(numbers, lambda x: F.concat(x, F.lit(". pick"))), "\n")).otherwise(F.array_join(numbers, ","))
        return self.train.select("user_id").distinct().select("user_id", reply.alias("reply"))

    @cached_property
    def places(self) -> DataFrame:
        """user_id, item_id, score, place, new_place of the first 30 candidates under the replies."""
        from stagewise.functions import parse

        window = self.cand.where("rank <= 30")
        n = window.groupBy("user_id").agg(F.count("*").alias("n"))
        orders = self.replies.join(n, "user_id").select("user_id", parse.positions(F.col("reply"), F.col("n")).alias("order"))
        to = orders.select("user_id", F.posexplode("order").alias("new_place", "place"))
        return window.select("user_id", "item_id", "score", (F.col("rank") - 1).alias("place")).join(to, ["user_id", "place"])

    @cached_property
    def two_arms(self) -> DataFrame:
        """user_id, a, b, n_hist: NDCG@10 of popularity and of its shuffle, on the multi-positive split."""
        a = self.mu.select("user_id", F.col("ndcg_10").alias("a"))
        b = metrics.per_user(rerank.shuffled(self.mcand), self.mtruth, ks=(10,)).select("user_id", F.col("ndcg_10").alias("b"))
        return a.join(b, "user_id").join(prepare.activity(self.mtrain).withColumnRenamed("n", "n_hist"), "user_id")


_BACK = "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k1 DESC, k2 DESC, item_id DESC, k3 DESC) AS back, count(*) OVER (PARTITION BY user_id) AS n"


def _popularity(train: str, k: int = 100, users: str = "", met: str = "") -> str:
    return f"""
SELECT user_id, rank, item_id, score FROM (
  SELECT u.user_id, row_number() OVER (PARTITION BY u.user_id ORDER BY p.n DESC, p.item_id) AS rank, p.item_id, p.n / p.most AS score
  FROM ({users or f'SELECT DISTINCT user_id FROM {train}'}) u,
       (SELECT item_id, n, CAST(max(n) OVER () AS DOUBLE) AS most FROM (SELECT item_id, count(*) AS n FROM {train} GROUP BY item_id)
        ORDER BY n DESC, item_id LIMIT (SELECT {k} + max(c) FROM (SELECT count(DISTINCT item_id) AS c FROM {train} GROUP BY user_id))) p
  WHERE NOT EXISTS (SELECT 1 FROM {met or train} t WHERE t.user_id = u.user_id AND t.item_id = p.item_id)) WHERE rank <= {k}"""


def _metrics(cand: str, truth: str, ks: tuple[int, ...] = (10, 20)) -> str:
    out = ""
    for k in ks:
        at = f"FILTER (h.rank <= {k})"
        out += f""",
 coalesce(sum(1 / log2(h.rank + 1)) {at}, 0) / any_value((SELECT v FROM idcg WHERE idcg.k = {k} AND idcg.n = least(s.n_truth, {k}))) AS ndcg_{k},
 count(h.rank) {at} / any_value(s.n_truth) AS recall_{k}, CASE WHEN count(h.rank) {at} > 0 THEN 1 ELSE 0 END AS hit_{k},
 coalesce(sum(h.nth / h.rank) {at}, 0) / any_value(least(s.n_truth, {k})) AS map_{k}"""
    return f"""
SELECT s.user_id, any_value(s.n_truth) AS n_truth, count(h.rank) FILTER (h.rank <= 100) AS m, coalesce(1 / min(h.rank), 0) AS mrr{out}
FROM (SELECT user_id, count(DISTINCT item_id) AS n_truth FROM {truth} GROUP BY user_id) s
LEFT JOIN (SELECT c.user_id, c.rank, row_number() OVER (PARTITION BY c.user_id ORDER BY c.rank) AS nth
           FROM {cand} c WHERE EXISTS (SELECT 1 FROM {truth} t WHERE t.user_id = c.user_id AND t.item_id = c.item_id)) h USING (user_id)
GROUP BY s.user_id"""


def hash_sql(key: str, seed: int = 42) -> str:
    return f"((({key}) * 2654435761 + {seed}) % 4294967296)"


def pair_hash_sql(seed: int = 42, user: str = "user_id", item: str = "item_id") -> str:
    return hash_sql(f"({user} * 1000003 + {item} * 7919) % 2000000011", seed)


#: Common table expressions by name; each may use those it names.
CTES = {
    "inter": "SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts, l_quantity AS rating, l_orderkey AS k1, l_linenumber AS k2, l_suppkey AS k3 FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "pairs": "SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, k1, k2, item_id, k3) AS nth FROM inter) WHERE nth = 1",
    "numbered": f"SELECT *, {_BACK} FROM pairs",
    "train": "SELECT * EXCLUDE (back, n) FROM numbered WHERE n >= 3 AND back > 1",
    "truth": "SELECT user_id, item_id FROM numbered WHERE n >= 3 AND back = 1",
    "mtrain": "SELECT * EXCLUDE (back, n) FROM numbered WHERE n > 7 AND back > 5",
    "mtruth": "SELECT user_id, item_id FROM numbered WHERE n > 7 AND back <= 5",
    "pop": "SELECT item_id, count(*) AS n FROM train GROUP BY item_id",
    "idcg": "SELECT k, n, (SELECT coalesce(sum(1 / log2(j + 1)), 0) FROM range(1, 21) t(j) WHERE j <= least(n, k)) AS v FROM (VALUES (10), (20)) a(k), range(0, 101) b(n)",
    "cand": _popularity("train"),
    "mcand": _popularity("mtrain"),
    "mcand101": _popularity("mtrain", 101),
    "able": "SELECT user_id, count(*) AS n_history FROM mtrain WHERE user_id IN (SELECT user_id FROM mtruth) GROUP BY user_id HAVING count(*) >= 3",
    "halves": f"SELECT user_id, n_history, CASE WHEN pl <= greatest(50, total // 2) THEN 'a' ELSE 'b' END AS half FROM (SELECT *, row_number() OVER (ORDER BY {hash_sql('user_id')}, user_id) AS pl, count(*) OVER () AS total FROM able)",
    "pool": "SELECT user_id FROM halves WHERE half = 'b' AND n_history >= 4",
    "mlast": "SELECT user_id, item_id FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k1 DESC, k2 DESC, item_id DESC, k3 DESC) AS back FROM mtrain WHERE user_id IN (SELECT user_id FROM pool)) WHERE back = 1",
    "mmet": "SELECT user_id, item_id FROM mtrain WHERE user_id IN (SELECT user_id FROM pool) EXCEPT SELECT user_id, item_id FROM mlast",
    "gcand": _popularity("mtrain", 100, "SELECT user_id FROM pool", "mmet"),
    "groups": "SELECT c.user_id, c.rank, c.item_id, c.score, CASE WHEN c.item_id = l.item_id THEN 1 ELSE 0 END AS label, count(*) OVER (PARTITION BY c.user_id) AS group_size FROM gcand c JOIN mlast l USING (user_id)",
    "mu": "SELECT * FROM mu_raw -- idcg",
    "item_text": "SELECT p_partkey AS item_id, concat_ws(' ', p_name, p_brand, p_type) AS text FROM part",
    "reply_numbers": "SELECT user_id, list_transform(range(0, 14), lambda i: CAST((user_id * 5 + i * ((user_id * 7) % 11 + 1)) % 34 + 1 AS VARCHAR)) AS x FROM (SELECT DISTINCT user_id FROM train)",
    "replies": "SELECT user_id, CASE user_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'I can''t rank these.' WHEN 2 THEN '<think>1 2 3</think>' || array_to_string(x, ', ') WHEN 3 THEN array_to_string(x[1:2], ',') WHEN 4 THEN array_to_string(list_transform(x, lambda i: i || '. pick'), chr(10)) ELSE array_to_string(x, ',') END AS reply FROM reply_numbers",
    "named": "SELECT user_id, n, list_distinct_ordered AS order_ FROM (SELECT r.user_id, w.n, list_filter(list_transform(list_filter(regexp_extract_all(regexp_replace(reply, '(?s)<think>.*?</think>', '', 'g'), '[0-9]+'), lambda s: length(s) <= 9), lambda s: CAST(s AS INTEGER) - 1), lambda v: v >= 0 AND v < w.n) AS list_distinct_ordered FROM replies r JOIN (SELECT user_id, count(*) AS n FROM cand WHERE rank <= 30 GROUP BY user_id) w USING (user_id))",
    "named_first": "SELECT user_id, n, v AS place, min(pl) AS pl FROM (SELECT user_id, n, unnest(order_) AS v, generate_subscripts(order_, 1) AS pl FROM named) GROUP BY user_id, n, v",
    "places": "SELECT c.user_id, c.item_id, c.score, c.rank - 1 AS place, row_number() OVER (PARTITION BY c.user_id ORDER BY f.pl NULLS LAST, c.rank) - 1 AS new_place FROM cand c LEFT JOIN named_first f ON f.user_id = c.user_id AND f.place = c.rank - 1 WHERE c.rank <= 30",
    "mshuffled": f"SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {pair_hash_sql()}, item_id) AS rank FROM mcand",
    "two_arms": "SELECT a.user_id, a.ndcg_10 AS a, b.ndcg_10 AS b, h.n_hist FROM mu a JOIN mu_shuffled b USING (user_id) JOIN (SELECT user_id, count(*) AS n_hist FROM mtrain GROUP BY user_id) h USING (user_id)",
    "mu_shuffled": _metrics("mshuffled", "mtruth", (10,)),
}
CTES["mu"] = _metrics("mcand", "mtruth")


def sql(body: str) -> str:
    """The statement with every common table expression that it uses, in order of use."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in CTES and word not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{word}\b", text):
                visit(CTES[word])
                if word not in needed:
                    needed.append(word)

    visit(body)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed) + "\n" if needed else "") + body


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a function of Frames as a query, with its SQL twin."""

    def wrap(f: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Frames(spark, sf_dir))
        if oracle:
            ORACLES[name] = sql(oracle)
        return f

    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as the SQL does."""
    return df.withColumns({c: binary_round(F.col(c), digits) if t == "double" else F.round(F.col(c), digits) for c, t in df.dtypes if t in ("double", "float")})


__all__ = ["ORACLES", "ORDER", "QUERIES", "F", "Frames", "W", "hash_sql", "pair_hash_sql", "query", "rounded", "sql"]
