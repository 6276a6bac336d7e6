"""Stage-2 rerankers, rank fusion, candidate interventions and learning-to-rank frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagewise.functions.arith import hash32, pair_hash32


def by(candidates: DataFrame, *order: Column | str) -> DataFrame:
    """Candidates ranked anew."""
    w = W.partitionBy("user_id").orderBy(*order)
    return candidates.withColumn("new_rank", F.row_number().over(w)).select("user_id", F.col("new_rank").cast("int").alias("rank"), "item_id", "score")


def identity(candidates: DataFrame) -> DataFrame:
    return candidates


def by_score(candidates: DataFrame) -> DataFrame:
    """By retrieval score; a missing score counts as -1e9."""
    return by(candidates, F.desc(F.coalesce("score", F.lit(-1e9))), "rank")


def reverse(candidates: DataFrame) -> DataFrame:
    return by(candidates, F.desc("rank"))


def shuffled(candidates: DataFrame, seed: int = 42) -> DataFrame:
    return by(candidates, pair_hash32("user_id", "item_id", seed), "item_id")


def by_popularity(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """counts: item_id, n."""
    rows = candidates.join(counts, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return by(rows, F.desc("n"), "rank")


def jittered(candidates: DataFrame, scale: float = 0.01, seed: int = 42) -> DataFrame:
    """Score plus a small jitter from the pair hash (mean 0, standard deviation ``scale``)."""
    noise = (pair_hash32("user_id", "item_id", seed) / F.lit(float(2**32)) - 0.5) * (scale * 12**0.5)
    return by(candidates.withColumn("noisy", F.round(F.col("score") + noise, 12)), F.desc("noisy"), "rank")


def flagged(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds hit (0 or 1)."""
    mark = truth.select("user_id", "item_id").distinct().withColumn("hit", F.lit(1))
    return candidates.join(mark, ["user_id", "item_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def oracle(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Hits first, each part in the order given: the ceiling of any reranker."""
    return by(flagged(candidates, truth), F.desc("hit"), "rank")


def fused_with_places(orders: DataFrame, constant: int = 60) -> DataFrame:
    """RRF of retrieval place and reply place. orders: user_id, item_id, score, place, new_place (0-based)."""
    rrf = 1 / (constant + F.col("place") + 1) + 1 / (constant + F.col("new_place") + 1)
    return by(orders.withColumn("fused", F.round(rrf, 12)), F.desc("fused"), "place")


def convex(orders: DataFrame, weight: Column) -> DataFrame:
    """weight x retrieval place score + (1 - weight) x reply place score; lists of one item stay.

    A column ``weight_id`` is added from the weight so that several can be compared.
    """
    n = F.count("*").over(W.partitionBy("user_id", "weight_id"))
    rows = orders.withColumn("weight_id", weight).withColumn("n", n)
    scale = F.nullif(F.col("n") - 1, F.lit(0))
    mixed = F.col("weight_id") * (1 - F.col("place") / scale) + (1 - F.col("weight_id")) * (1 - F.col("new_place") / scale)
    w = W.partitionBy("user_id", "weight_id").orderBy(F.desc(F.round(F.coalesce(mixed, F.lit(0.0)), 9)), "place")
    return rows.withColumn("rank", F.row_number().over(w)).select("user_id", "weight_id", F.col("rank").cast("int").alias("rank"), "item_id")


def rank_average(orders: DataFrame) -> DataFrame:
    return by(orders.withColumn("mean", (F.col("place") + F.col("new_place")) / 2), "mean", "place")


def scaled_sum(orders: DataFrame, weight: float = 0.5) -> DataFrame:
    """weight x min-max score of the first ranker + the rest of the second's (column ``other``)."""
    w = W.partitionBy("user_id")

    def unit(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.col(c))

    mixed = F.round(weight * unit("score") + (1 - weight) * unit("other"), 9)
    return by(orders.withColumn("mixed", mixed), F.desc("mixed"), "item_id")


def route(users: DataFrame, user_low: int = 10, item_low: int = 10) -> DataFrame:
    """expert 1 for cold users or rare items, else 0. users: any rows with user_degree, item_degree, cold."""
    return users.withColumn("expert", F.when(F.col("cold") | (F.col("user_degree") < user_low) | (F.col("item_degree") < item_low), 1).otherwise(0))


def cascade(first: DataFrame, second: DataFrame, activity: DataFrame, threshold: int) -> DataFrame:
    """Users with at most ``threshold`` rows get the second list. activity: user_id, n."""
    cold = activity.where(F.col("n") <= threshold).select("user_id")
    return first.join(cold, "user_id", "left_anti").unionByName(second.join(cold, "user_id", "left_semi"))


# interventions -----------------------------------------------------------------------


def _mixed(items: Column, seed: int) -> Column:
    """An array of items in hash order of (user, item)."""
    keyed = F.array_sort(F.transform(items, lambda x: F.struct(pair_hash32(F.col("user_id"), x, seed).alias("h"), x.alias("x"))))
    return F.transform(keyed, lambda s: s["x"])


def _lists(candidates: DataFrame, k: int) -> DataFrame:
    """user_id, items: each user's first k candidates as an array."""
    g = candidates.where(F.col("rank") <= k).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    return g.select("user_id", F.transform("l", lambda x: x["item_id"]).alias("items"))


def _unrolled(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """arm, user_id, rank, item_id of named arrays: one row per user is unrolled, no list is read twice."""
    arms_ = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), c.alias("items")) for n, c in named.items()])).alias("a")
    return rows.select("user_id", arms_).select(F.col("a.arm").alias("arm"), "user_id", F.posexplode("a.items").alias("at", "item_id")).select("arm", "user_id", (F.col("at") + 1).cast("int").alias("rank"), "item_id")


def arms(candidates: DataFrame, truth: DataFrame, gold: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """arm, user_id, rank, item_id of five interventions on lists of k.

    as_is; drop_hits: hits taken out; gold_last / gold_first: one unretrieved positive put in
    the last / the first place; shuffled. gold: user_id, item_id (at most one per user).
    """
    hits = truth.groupBy("user_id").agg(F.collect_set("item_id").alias("hits"))
    rows = _lists(candidates, k).join(hits, "user_id", "left").join(gold.select("user_id", F.col("item_id").alias("gold")), "user_id", "left")
    items, none = F.col("items"), F.array().cast("array<bigint>")
    room = F.slice(items, F.lit(1), F.size(items) - 1)
    put = lambda c: F.when(F.col("gold").isNull(), items).otherwise(c)
    named = {
        "as_is": items, "drop_hits": F.filter(items, lambda x: ~F.array_contains(F.coalesce("hits", none), x)),
        "gold_last": put(F.concat(room, F.array("gold"))), "gold_first": put(F.concat(F.array("gold"), room)), "shuffled": _mixed(items, seed),
    }
    return _unrolled(rows, named)


def interventions(candidates: DataFrame, truth: DataFrame, history: DataFrame, k: int = 100, window: int = 30, seed: int = 42) -> DataFrame:
    """arm, user_id, rank, item_id of six interventions, each a list of exactly k.

    R: as retrieved; drop30 / gold30: place ``window`` goes to the item at k + 1, or to a gold
    item; gold01: the gold item comes first and the window moves down; shuffle: the window in
    hash order; oracle: the first nine tenths, then positives that weren't retrieved, in hash
    order. The gold item is drawn by hash from positives that were neither retrieved nor met
    in training; without one the item at k + 1 stands in. Users with fewer than k + 1
    candidates or without truth are left out.
    """
    gt = truth.groupBy("user_id").agg(F.array_sort(F.collect_set("item_id")).alias("truth"))
    met = history.groupBy("user_id").agg(F.collect_set("item_id").alias("met"))
    rows = _lists(candidates, k + 1).where(F.size("items") == k + 1).join(gt, "user_id").join(met, "user_id", "left")
    rows = rows.select("user_id", F.slice("items", 1, k).alias("base"), F.element_at("items", k + 1).alias("filler"), "truth", F.coalesce("met", F.array().cast("array<bigint>")).alias("met"))
    rows = rows.withColumn("missed", F.array_except("truth", "base")).withColumn("ins", F.coalesce(F.get(_mixed(F.array_except("missed", "met"), seed + 1), F.lit(0)), F.col("filler")))
    head, tail = F.slice("base", 1, window - 1), F.slice("base", window + 1, k - window)
    kept = k - k // 10
    oracle = F.slice(F.concat(F.slice("base", 1, kept), "missed"), 1, k)
    oracle = F.slice(F.concat(oracle, F.array_except(F.slice("base", kept + 1, k - kept), oracle)), 1, k)
    named = {
        "R": F.col("base"), "drop30": F.concat(head, F.array("filler"), tail), "gold30": F.concat(head, F.array("ins"), tail), "gold01": F.concat(F.array("ins"), head, tail),
        "shuffle": F.concat(_mixed(F.slice("base", 1, window), seed), tail), "oracle": _mixed(oracle, seed),
    }
    return _unrolled(rows, named)


def injected(candidates: DataFrame, truth: DataFrame, k: int, keep: int, seed: int = 42) -> DataFrame:
    """The first ``keep`` candidates and all positives, cut to k, in hash order."""
    head = candidates.where(F.col("rank") <= keep).select("user_id", "item_id", F.lit(1).alias("source"), "rank")
    gold = truth.select("user_id", "item_id").distinct().withColumn("source", F.lit(0)).withColumn("rank", F.lit(0))
    once = W.partitionBy("user_id", "item_id").orderBy("source")
    rows = head.unionByName(gold).withColumn("nth", F.row_number().over(once)).where("nth = 1")
    w = W.partitionBy("user_id").orderBy("source", "rank", "item_id")
    rows = rows.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k).withColumn("score", F.lit(0.0))
    return shuffled(rows, seed)


def controlled(candidates: DataFrame, truth: DataFrame, target: Column, k: int, seed: int = 42) -> DataFrame:
    """user_id, item_id, source: floor(target x positives) positives by hash order, then non-hits up to k."""
    n = truth.groupBy("user_id").agg(F.count_distinct("item_id").alias("n_truth"))
    order = W.partitionBy("user_id").orderBy(pair_hash32("user_id", "item_id", seed), "item_id")
    gold = truth.select("user_id", "item_id").distinct().join(n, "user_id").withColumn("at", F.row_number().over(order))
    gold = gold.where(F.col("at") <= F.floor(target * F.col("n_truth") + 1e-9)).select("user_id", F.lit(0).alias("source"), F.col("at").alias("rank"), "item_id")
    rest = flagged(candidates, truth).where("hit = 0").select("user_id", F.lit(1).alias("source"), "rank", "item_id")
    w = W.partitionBy("user_id").orderBy("source", "rank", "item_id")
    rows = gold.unionByName(rest).withColumn("at", F.row_number().over(w)).where(F.col("at") <= k)
    return rows.select("user_id", F.col("at").cast("int").alias("rank"), "item_id", F.when(F.col("source") == 0, "gold").otherwise("fill").alias("source"))


# learning to rank --------------------------------------------------------------------


def features(candidates: DataFrame, counts: DataFrame, history: DataFrame) -> DataFrame:
    """The five features without vectors: score, place share, log popularity, log history, reciprocal place."""
    n = candidates.groupBy("user_id").agg(F.count("*").alias("n"))
    rows = candidates.join(n, "user_id").join(counts.select("item_id", F.col("n").alias("pop")), "item_id", "left").join(history.groupBy("user_id").agg(F.count("*").alias("n_hist")), "user_id", "left")
    i = F.col("rank") - 1
    return rows.select("user_id", "item_id", "rank", F.col("score").alias("f_score"), (i / F.col("n")).alias("f_place"), F.log1p(F.coalesce("pop", F.lit(0))).alias("f_pop"), F.log1p(F.coalesce("n_hist", F.lit(0))).alias("f_hist"), (1 / (i + 1)).alias("f_recip"))


def vector_features(candidates: DataFrame, history: DataFrame, vectors: DataFrame, last: int = 10) -> DataFrame:
    """user_id, item_id, cosine with the user's mean, mean dot with its last items, and the item's norm.

    history: user_id, item_id, back (1 is the last); vectors: item_id, vector.
    """
    from stagewise.operators.retrieve import dot

    v = vectors.select("item_id", "vector")
    own = history.join(v, "item_id")
    parts = own.select("user_id", "back", F.posexplode("vector").alias("d", "x")).groupBy("user_id", "d").agg(F.avg("x").alias("mean"), F.avg(F.when(F.col("back") <= last, F.col("x"))).alias("late"))
    pack = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("d", F.coalesce(c, F.lit(0.0)).alias("x")))), lambda s: s["x"])
    users = parts.groupBy("user_id").agg(pack("mean").alias("u"), pack("late").alias("l"))
    rows = candidates.select("user_id", "item_id").join(v, "item_id").join(users, "user_id")
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    return rows.select("user_id", "item_id", (dot(F.col("u"), F.col("vector")) / F.nullif(norm("u") * norm("vector"), F.lit(0.0))).alias("f_cos"), dot(F.col("l"), F.col("vector")).alias("f_late"), norm("vector").alias("f_norm"))


def text_features(candidates: DataFrame, history: DataFrame, items: DataFrame, vectors: DataFrame, last: int = 20) -> DataFrame:
    """user_id, item_id, BM25 of the item for the user's last texts, dot with their mean vector, and both 0-based ranks over the list's length.

    history: user_id, item_id, back (1 is the last); items: item_id, text; vectors: item_id,
    vector. What has no text or vector scores 0; ties go to the smaller item.
    """
    from stagewise.operators.retrieve import bm25, mean_vectors

    recent = history.where(F.col("back") <= last).select("user_id", "item_id")
    asked = recent.join(items, "item_id").groupBy("user_id").agg(F.array_join(F.collect_list("text"), " ").alias("text")).select(F.col("user_id").alias("query_id"), "text")
    pairs = candidates.select("user_id", "item_id")
    words = bm25(items, asked, pairs=pairs.withColumnRenamed("user_id", "query_id")).select(F.col("query_id").alias("user_id"), "item_id", F.col("score").alias("f_bm25"))
    from stagewise.operators.retrieve import dot

    close = pairs.join(vectors, "item_id").join(mean_vectors(vectors, recent), "user_id").select("user_id", "item_id", F.round(dot(F.col("m"), F.col("vector")), 9).alias("f_dense"))
    rows = pairs.join(words, ["user_id", "item_id"], "left").join(close, ["user_id", "item_id"], "left").fillna(0.0, ["f_bm25", "f_dense"])
    own = W.partitionBy("user_id")
    place = lambda c: (F.row_number().over(own.orderBy(F.desc(c), "item_id")) - 1) / F.count("*").over(own)
    return rows.select("user_id", "item_id", "f_bm25", "f_dense", place("f_bm25").alias("f_bm25_place"), place("f_dense").alias("f_dense_place"))


def clean_groups(train: DataFrame, pool: DataFrame, k: int = 100) -> DataFrame:
    """Groups to learn from without a look at the evaluation: user_id, rank, item_id, score, label, group_size.

    The label is the last training item of each user of the pool, which is taken out of what
    retrieval leaves out. Evaluated users must not be in the pool.
    """
    from stagewise.operators.retrieve import popularity
    from stagewise.operators.split import held_out_label

    pool = pool.select("user_id")
    label = held_out_label(train).join(pool, "user_id", "left_semi")
    own = train.join(pool, "user_id", "left_semi").select("user_id", "item_id")
    met = own.join(label, (own.user_id == label.user_id) & (own.item_id == label.label_item), "left_anti")
    found = popularity(train, k, exclude=met, users=pool)
    return labelled_groups(found, label).join(found.select("user_id", "item_id", "score"), ["user_id", "item_id"])


def labelled_groups(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """user_id, rank, item_id, label, group_size. labels: user_id, label_item."""
    rows = candidates.join(labels, "user_id")
    return rows.select("user_id", "rank", "item_id", (F.col("item_id") == F.col("label_item")).cast("int").alias("label"), F.count("*").over(W.partitionBy("user_id")).alias("group_size"))


def preference_pairs(groups: DataFrame, negatives: int = 5) -> DataFrame:
    """user_id, positive, negative: each positive with the first negatives of its group."""
    w = W.partitionBy("user_id").orderBy("rank")
    low = groups.where("label = 0").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= negatives).select("user_id", F.col("item_id").alias("negative"), "nth")
    return groups.where("label = 1").select("user_id", F.col("item_id").alias("positive")).join(low, "user_id")


def weighted_features(rows: DataFrame) -> DataFrame:
    """.4 score + .3 cosine + .2 overlap + .1 popularity. rows: user_id, item_id, rank, score, cosine, overlap, pop (0..1)."""
    mixed = 0.4 * F.col("score") + 0.3 * F.col("cosine") + 0.2 * F.col("overlap") + 0.1 * F.col("pop")
    return by(rows.withColumn("mixed", F.round(mixed, 9)), F.desc("mixed"), "rank")


#: Weights of score, cosine, popularity and reciprocal place after the attention.
ATTENDED = (0.4, 0.3, 0.2, 0.1)


def attention_smoothed(rows: DataFrame) -> DataFrame:
    """Each list's features mixed by softmax(Q Q' / sqrt(5)) and then weighed; ties keep their places.

    rows: user_id, item_id, rank, score, cosine (null: the item or the user has no vector, and
    all its features are 0), pop (a count). Lists of a batch that are as long as each other are
    mixed at once.
    """
    lists = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", F.col("score").cast("double").alias("score"), F.col("cosine").cast("double").alias("cosine"), F.coalesce("pop", F.lit(0)).cast("double").alias("pop")))).alias("r"))
    return mixed_lists(lists.select("user_id", *[F.col(f"r.{c}").alias(c) for c in ("item_id", "score", "cosine", "pop")]))


def mixed_lists(lists: DataFrame) -> DataFrame:
    """``attention_smoothed`` of arrays in order of rank: user_id, item_id, score, cosine, pop."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    def mix(score: np.ndarray, cosine: np.ndarray, pop: np.ndarray) -> np.ndarray:
        at = np.arange(score.shape[1])
        place = np.broadcast_to(at, score.shape)
        q = np.stack([score, cosine, np.log1p(pop), 1 / (place + 1), place / score.shape[1]], axis=2)
        q[np.isnan(cosine)] = 0
        z = q @ q.transpose(0, 2, 1) / np.sqrt(5)
        a = np.exp(z - z.max(axis=2, keepdims=True))
        final = (a / (a.sum(axis=2, keepdims=True) + 1e-10) @ q)[:, :, :4] @ np.array(ATTENDED)
        return np.argsort(-final.round(9), axis=1, kind="stable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                batch = whole.slice(lo, 1024)
                users, ends = batch.column(0).to_numpy(), batch.column(1).offsets.to_numpy().astype(np.int64)
                items, *parts = (batch.column(c).values.to_numpy(zero_copy_only=False) for c in range(1, 5))
                n = np.diff(ends)
                for length in np.unique(n[n > 0]):
                    for some in np.array_split(np.flatnonzero(n == length), max(1, int((n == length).sum() * length * length) >> 20)):
                        at = ends[some][:, None] + np.arange(length)
                        order = mix(*(x[at].astype(np.float64) for x in parts))
                        ranks = np.tile(np.arange(1, length + 1, dtype=np.int32), len(some))
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(users[some], length)), pa.array(ranks), pa.array(np.take_along_axis(items[at], order, axis=1).ravel())], ["user_id", "rank", "item_id"])

    return lists.select("user_id", "item_id", "score", "cosine", "pop").mapInArrow(run, "user_id long, rank int, item_id long")


def denoised(candidates: DataFrame, steps: int = 5, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """Scores noised in growing steps, blended back with themselves, and raised by the gap to what stands before.

    Step t of n adds noise of the scale t / n, drawn by hash in place of a normal (evenly, with
    its variance); going back, each step keeps the share t / n of the noise. In list order a
    score then gains a twentieth of its distance to the nearest score before it.
    """
    def drawn(t: int) -> Column:
        return (hash32(F.pmod(F.col("user_id") * F.lit(1_000_003) + F.col("item_id") * F.lit(7919), F.lit(2_000_000_011)), seed + t) / F.lit(float(2**32)) - 0.5) * float(12**0.5)

    share = 1.0
    for t in range(1, steps + 1):
        share *= t / steps
    total = sum((drawn(t) * (noise * t / steps) for t in range(1, steps + 1)), F.lit(0.0))
    rows = candidates.withColumn("s", F.col("score") + share * total)
    lists = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "s"))).alias("l"))
    gap = lambda done, x: F.array_min(F.transform(done, lambda y: F.abs(x - y)))
    raised = F.aggregate("l", F.array().cast("array<double>"), lambda done, x: F.concat(done, F.array(x["s"] + F.coalesce(0.05 * gap(done, x["s"]), F.lit(0.0)))))
    out = lists.select("user_id", F.posexplode(F.arrays_zip("l", raised.alias("f"))).alias("at", "z")).select("user_id", F.col("z.l.item_id").alias("item_id"), F.col("z.l.rank").alias("rank"), F.col("z.l.s").alias("score"), F.round("z.f", 9).alias("final"))
    return by(out, F.desc("final"), "rank")
