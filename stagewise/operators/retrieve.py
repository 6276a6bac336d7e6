"""Stage-1 retrieval: candidates (user_id, rank, item_id, score) from a training frame.

Ties go to the smaller item_id; excluded items never appear; a user unknown to training
gets nothing unless a fallback is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagewise.functions.arith import binary_round
from stagewise.operators.prepare import dense_ids

#: Exclusions up to which a user's popular items come from the array sent to every task.
SHORT = 1000


def top_k(scored: DataFrame, k: int | Column, by: str = "score") -> DataFrame:
    """The best k of each user, ranked from 1."""
    w = W.partitionBy("user_id").orderBy(F.desc(by), "item_id")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select("user_id", F.col("rank").cast("int").alias("rank"), "item_id", F.col("score").cast("double").alias("score"))


def unseen(scored: DataFrame, exclude: DataFrame) -> DataFrame:
    return scored.join(exclude.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def popular_lists(own: DataFrame, counts: DataFrame, k: int = 100) -> DataFrame:
    """The rows of ``own`` (user_id, own: an array of items that are left out, any other columns) with list: the k most frequent items (item_id, pop, score) in order.

    counts: item_id, n. A user with m own items needs the first k + m items only, whatever
    others need. Users with up to ``SHORT`` own items get them from one small array, of which
    their own items are taken away; longer ones meet the ranked items row by row. So what is
    sent to every task doesn't grow with the longest history.
    """
    head = counts.orderBy(F.desc("n"), "item_id").limit(k + SHORT)
    head = head.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "item_id"))).alias("head"))
    head = F.broadcast(head.select(F.transform("head", lambda x: x["item_id"]).alias("head_items"), F.transform("head", lambda x: -x["minus"]).alias("head_pop")))
    kept = F.slice(F.array_except(F.slice("head_items", F.lit(1), F.size("own") + k), F.col("own")), 1, k)
    pop = lambda x: F.element_at("head_pop", F.array_position("head_items", x).cast("int"))
    listed = F.transform(kept, lambda x: F.struct(x.alias("item_id"), pop(x).alias("pop"), (pop(x) / F.col("head_pop")[0]).alias("score")))
    # the arrays of the head end here: an explode would copy them to every row
    few = own.where(F.size("own") <= SHORT).join(head).select(*own.columns, listed.alias("list"))
    long = own.where(F.size("own") > SHORT)
    if long.isEmpty():
        return few
    most = counts.agg(F.max("n").alias("most"))
    ranked = dense_ids(counts.select(F.struct((-F.col("n")).alias("minus"), "item_id").alias("key")), "key")
    places = long.select("user_id", "own", F.explode(F.sequence(F.lit(0).cast("long"), (F.size("own") + (k - 1)).cast("long"))).alias("dense_id"))
    left = places.join(ranked, "dense_id").where(~F.array_contains("own", F.col("raw_id.item_id"))).join(F.broadcast(most))
    first = left.groupBy("user_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("dense_id", F.col("raw_id.item_id").alias("item_id"), (-F.col("raw_id.minus")).alias("pop"), (-F.col("raw_id.minus") / F.col("most")).alias("score")))), 1, k).alias("list"))
    many = long.join(first.select("user_id", F.transform("list", lambda x: F.struct(x["item_id"].alias("item_id"), x["pop"].alias("pop"), x["score"].alias("score"))).alias("list")), "user_id")
    return few.unionByName(many.select(*few.columns))


def unrolled(lists: DataFrame, *more: str) -> DataFrame:
    """user_id, rank, item_id, score of ``popular_lists``, and further columns; pop and n (the list's length) can be among them."""
    rows = lists.select("user_id", *[F.size("list").alias("n") if c == "n" else c for c in more if c != "pop"], F.posexplode("list").alias("at", "x"))
    return rows.select("user_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.item_id").alias("item_id"), F.col("x.score").alias("score"), *["x.pop" if c == "pop" else c for c in more])


def popularity(train: DataFrame, k: int = 100, exclude: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """Most frequent items that the user hasn't met; score is count / largest count."""
    exclude = train if exclude is None else exclude
    own = exclude.groupBy("user_id").agg(F.collect_set("item_id").alias("own"))
    if users is not None:
        own = users.select("user_id").join(own, "user_id", "left").select("user_id", F.coalesce("own", F.array().cast("array<bigint>")).alias("own"))
    return unrolled(popular_lists(own, train.groupBy("item_id").agg(F.count("*").alias("n")), k))


def own_items(rows: DataFrame) -> DataFrame:
    """user_id, own: each user's distinct items."""
    return rows.groupBy("user_id").agg(F.collect_set("item_id").alias("own"))


def random_items(train: DataFrame, k: int = 100, seed: int = 42, users: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """Items in hash order of (user, item); score is the hash as a share. own: user_id, own of train, where it is at hand."""
    from stagewise.operators.blocks import best_by_passes, meet_hashes

    own = own_items(train) if own is None else own
    items = own.select(F.explode("own").alias("item_id")).distinct().select("item_id", F.array().cast("array<double>").alias("vector"))
    rows = own if users is None else users
    return best_by_passes(rows.select("user_id", F.array().cast("array<double>").alias("vectors")), items, k, meet_hashes(seed), exclude=own)


def item_similarity(train: DataFrame) -> DataFrame:
    """i, j, cosine of all item pairs with a common user: half the pairs are summed, then mirrored."""
    rows = train.select("user_id", "item_id").distinct()
    a, b = rows.select("user_id", F.col("item_id").alias("i")), rows.select("user_id", F.col("item_id").alias("j"))
    common = a.join(b, "user_id").where("i < j").groupBy("i", "j").agg(F.count("*").alias("both"))
    n = rows.groupBy("item_id").agg(F.count("*").alias("n"))
    sim = common.join(n.select(F.col("item_id").alias("i"), F.col("n").alias("ni")), "i").join(n.select(F.col("item_id").alias("j"), F.col("n").alias("nj")), "j")
    sim = sim.select("i", "j", (F.col("both") / F.sqrt(F.col("ni") * F.col("nj"))).alias("sim"))
    return sim.unionByName(sim.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim"))


def knn_scores(train: DataFrame, neighbours: int = 50) -> DataFrame:
    """user_id, item_id, score of every item with a neighbour in the user's history, own items included."""
    near = W.partitionBy("i").orderBy(F.desc(F.round("sim", 9)), "j")
    sim = item_similarity(train).withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= neighbours)
    own = train.select("user_id", F.col("item_id").alias("i")).distinct()
    return own.join(sim, "i").groupBy("user_id", F.col("j").alias("item_id")).agg(F.round(F.sum("sim"), 9).alias("score"))


def full_average(first: DataFrame, second: DataFrame, train: DataFrame, k: int = 100, weight: float = 0.5) -> DataFrame:
    """weight x first + (1 - weight) x second, each scaled by its least and largest score over the whole catalog.

    first and second: user_id, item_id, score of all items that score at all (others are 0),
    own ones included; these are left out after scaling. Items that score in neither list
    are not listed.
    """
    n = train.agg(F.count_distinct("item_id").alias("n_items"))

    def scaled(scores: DataFrame, share: float) -> DataFrame:
        g = scores.groupBy("user_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("c")).join(F.broadcast(n))
        lo, hi = (F.when(F.col("c") < F.col("n_items"), how(F.col(c), F.lit(0.0))).otherwise(F.col(c)) for how, c in ((F.least, "lo"), (F.greatest, "hi")))
        span = g.select("user_id", lo.alias("lo"), (hi - lo + 1e-8).alias("span"))
        # what an item without a score gets is taken off and added for every item once
        return scores.join(span, "user_id").select("user_id", "item_id", (share * F.col("score") / F.col("span")).alias("s"), F.lit(None).cast("double").alias("base")).unionByName(span.select("user_id", F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("s"), (-share * F.col("lo") / F.col("span")).alias("base")))

    both = scaled(first, weight).unionByName(scaled(second, 1 - weight))
    base = both.where("item_id is null").groupBy("user_id").agg(F.sum("base").alias("base"))
    sums = both.where("item_id is not null").groupBy("user_id", "item_id").agg(F.sum("s").alias("s")).join(base, "user_id")
    return top_k(unseen(sums.select("user_id", "item_id", F.round(F.col("s") + F.col("base"), 9).alias("score")), train), k)


def item_knn(train: DataFrame, k: int = 100, neighbours: int | None = None, users: DataFrame | None = None, similarity: DataFrame | None = None) -> DataFrame:
    """Sum of similarities to the user's items, over all or each item's nearest ``neighbours``."""
    sim = item_similarity(train) if similarity is None else similarity
    if neighbours:
        near = W.partitionBy("i").orderBy(F.desc(F.round("sim", 9)), "j")
        sim = sim.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= neighbours)
    own = train.select("user_id", F.col("item_id").alias("i")).distinct()
    own = own if users is None else own.join(users.select("user_id"), "user_id", "left_semi")
    scored = own.join(sim, "i").groupBy("user_id", F.col("j").alias("item_id")).agg(F.round(F.sum("sim"), 9).alias("score"))
    return top_k(unseen(scored, train), k)


def profile_knn(train: DataFrame, k: int = 100, users: DataFrame | None = None) -> DataFrame:
    """Large catalogs: cosine of each item's users with the user's profile, the sum of its items' vectors."""
    rows = train.select("user_id", "item_id").distinct()
    n = rows.groupBy("item_id").agg(F.sqrt(F.count("*")).alias("norm"))
    unit = rows.join(n, "item_id").select("user_id", "item_id", (1 / F.col("norm")).alias("w"))
    want = rows if users is None else rows.join(users.select("user_id"), "user_id", "left_semi")
    # whole numbers and decimals add up to the same sum in any order; no sum of w or p * w exceeds a history's length
    exact = lambda x: F.sum(F.round(x * F.lit(1e12)).cast("long")) / F.lit(1e12)
    profile = want.select(F.col("user_id").alias("who"), "item_id").join(unit, "item_id").groupBy("who", "user_id").agg(exact(F.col("w")).alias("p"))
    length = profile.groupBy("who").agg(F.sqrt(F.sum((F.col("p") * F.col("p")).cast("decimal(28,12)")).cast("double")).alias("length"))
    dots = profile.join(unit, "user_id").groupBy("who", "item_id").agg(exact(F.col("p") * F.col("w")).alias("dot"))
    scored = dots.join(length, "who").select(F.col("who").alias("user_id"), "item_id", binary_round(F.col("dot") / F.col("length"), 9).alias("score"))
    return top_k(unseen(scored, train), k)


def cooccurrence(train: DataFrame, order: list[str], window: int = 10) -> DataFrame:
    """i, j, share of i's neighbours within ``window`` positions of the same history."""
    w = W.partitionBy("user_id").orderBy(*order)
    rows = train.withColumn("pos", F.row_number().over(w)).select("user_id", "item_id", "pos")
    # the positions that meet are listed, not all pairs of a history compared
    ahead = rows.select("user_id", F.col("item_id").alias("i"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + window)).alias("pos"))
    near = ahead.join(rows.select("user_id", "pos", F.col("item_id").alias("j")), ["user_id", "pos"]).where("i <> j")
    once = near.select(F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("x"))
    counts = once.groupBy("x.i", "x.j").agg(F.count("*").alias("c"))
    return counts.select("i", "j", (F.col("c") / F.sum("c").over(W.partitionBy("i"))).alias("sim"))


def cooccurrence_scores(train: DataFrame, order: list[str], last: int = 20, window: int = 10) -> DataFrame:
    """user_id, item_id, score of every item that co-occurs with the user's last ones, own items included."""
    back = W.partitionBy("user_id").orderBy(*[F.desc(c) for c in order])
    own = train.withColumn("stagewise_back", F.row_number().over(back)).where(F.col("stagewise_back") <= last).select("user_id", F.col("item_id").alias("i"))
    return own.join(cooccurrence(train, order, window), "i").groupBy("user_id", F.col("j").alias("item_id")).agg(F.round(F.sum("sim"), 9).alias("score"))


def cooccurrence_recall(train: DataFrame, order: list[str], k: int = 100, last: int = 20, window: int = 10, users: DataFrame | None = None) -> DataFrame:
    """Sum of co-occurrence shares with the user's last items."""
    back = W.partitionBy("user_id").orderBy(*[F.desc(c) for c in order])
    own = train.withColumn("back", F.row_number().over(back)).where(F.col("back") <= last).select("user_id", F.col("item_id").alias("i"))
    own = own if users is None else own.join(users.select("user_id"), "user_id", "left_semi")
    scored = own.join(cooccurrence(train, order, window), "i").groupBy("user_id", F.col("j").alias("item_id")).agg(F.round(F.sum("sim"), 9).alias("score"))
    return top_k(unseen(scored, train), k)


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def bm25(items: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, pairs: DataFrame | None = None) -> DataFrame:
    """query_id, item_id, score of Okapi BM25; a query's repeated terms count again.

    items: item_id, text; queries: query_id, text. Negative idf becomes ``floor`` times
    the mean idf. Items without tokens are the token "_empty_". With ``pairs`` (query_id,
    item_id) only those are scored.
    """
    words = items.select("item_id", tokens(F.col("text")).alias("w")).select("item_id", F.when(F.size("w") > 0, F.col("w")).otherwise(F.array(F.lit("_empty_"))).alias("w"))
    if pairs is None:
        return _bm25_by_text(words, queries, k1, b, floor)
    lengths = words.select("item_id", F.size("w").alias("dl"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = words.select("item_id", F.explode("w").alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats))
    raw = df.select("term", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf").alias("mean"))
    idf = raw.join(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, floor * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("q"))
    weight = F.col("q") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = tf.join(lengths, "item_id").join(F.broadcast(stats)).join(idf, "term")
    met = asked.join(hits, "term") if pairs is None else pairs.join(hits, "item_id").join(asked, ["query_id", "term"])
    return met.groupBy("query_id", "item_id").agg(F.round(F.sum(weight), 9).alias("score"))


def _bm25_by_text(words: DataFrame, queries: DataFrame, k1: float, b: float, floor: float) -> DataFrame:
    """``bm25`` of all queries and items: items, and queries, with the same terms are scored once.

    What is shuffled are the scores of different texts; those of items come out of a join by
    text, and queries, 16 bytes each, are sent to every task, so that the rows of the answer
    aren't dealt anew.
    """
    from stagewise.functions.lineage import kept

    key = lambda w: F.sha2(F.array_join(F.array_sort(w), " "), 256)
    members = kept(words.select("item_id", key(F.col("w")).alias("text"), "w"), "texts")
    texts = kept(members.groupBy("text").agg(F.any_value("w").alias("w"), F.count("*").alias("many")), "different-texts")
    stats = texts.agg(F.sum("many").alias("n"), (F.sum(F.col("many") * F.size("w")) / F.sum("many")).alias("avgdl"))
    tf = texts.select("text", "many", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("text", "many", "dl", "term").agg(F.count("*").alias("tf"))
    raw = tf.groupBy("term").agg(F.sum("many").alias("df")).join(F.broadcast(stats)).select("term", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf").alias("mean"))
    idf = raw.join(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, floor * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    asking = kept(queries.select("query_id", tokens(F.col("text")).alias("w")).where(F.size("w") > 0).select("query_id", key(F.col("w")).alias("question"), "w"), "queries")
    asked = asking.groupBy("question").agg(F.any_value("w").alias("w")).select("question", F.explode("w").alias("term")).groupBy("question", "term").agg(F.count("*").alias("q"))
    weight = F.col("q") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = asked.join(tf.join(F.broadcast(stats)).join(idf, "term"), "term").groupBy("text", "question").agg(F.round(F.sum(weight), 9).alias("score"))
    return members.select("item_id", "text").join(scores, "text").join(F.broadcast(asking.select("query_id", "question")), "question").select("query_id", "item_id", "score")


def tf_idf(items: DataFrame, features: int = 500) -> DataFrame:
    """item_id, term, weight: L2-normalised tf x (ln((1 + n) / (1 + df)) + 1) over the most frequent terms."""
    tf = items.select("item_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("tf"))
    vocabulary = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(features)
    n = items.agg(F.count("*").alias("n"))
    w = tf.join(F.broadcast(vocabulary), "term").join(F.broadcast(n)).select("item_id", "term", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    return w.select("item_id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("item_id")))).alias("weight"))


def text_blend(candidates: DataFrame, history: DataFrame, vectors: DataFrame, k: int = 100, share: float = 0.3) -> DataFrame:
    """(1 - share) x score + share x cosine of the item with the mean of the user's item vectors."""
    n = history.groupBy("user_id").agg(F.count("*").alias("n"))
    profile = history.select("user_id", "item_id").join(vectors, "item_id").groupBy("user_id", "term").agg(F.sum("weight").alias("w")).join(n, "user_id").select("user_id", "term", (F.col("w") / F.col("n")).alias("p"))
    length = profile.groupBy("user_id").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("length"))
    dots = candidates.select("user_id", "item_id").join(vectors, "item_id").join(profile, ["user_id", "term"]).groupBy("user_id", "item_id").agg(F.sum(F.col("weight") * F.col("p")).alias("dot"))
    cosine = F.coalesce(F.col("dot") / F.nullif(F.col("length"), F.lit(0.0)), F.lit(0.0))
    scored = candidates.join(dots, ["user_id", "item_id"], "left").join(length, "user_id", "left")
    return top_k(scored.select("user_id", "item_id", F.round((1 - share) * F.col("score") + share * cosine, 9).alias("score")), k)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_vectors(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """user_id, m: the normalised mean vector of each group's items."""
    parts = groups.join(vectors, "item_id").select("user_id", F.posexplode("vector").alias("d", "x"))
    mean = parts.groupBy("user_id", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = mean.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("m"))
    return mean.select("user_id", F.transform("m", lambda x: x / (F.sqrt(dot(F.col("m"), F.col("m"))) + 1e-9)).alias("m"))


def dense(vectors: DataFrame, groups: DataFrame, k: int = 10) -> DataFrame:
    """Items by dot product with the normalised mean vector of each group's items.

    vectors: item_id, vector; groups: user_id, item_id.
    """
    from stagewise.operators.blocks import best_of_all

    return best_of_all(mean_vectors(vectors, groups).withColumnRenamed("m", "vector"), vectors, k, exclude=groups)


def from_interests(interests: DataFrame, items: DataFrame, k: int = 100) -> DataFrame:
    """Candidates from given embeddings, several per user: an item's score is its best dot product."""
    from stagewise.operators.blocks import best_of_all

    return best_of_all(interests.withColumnRenamed("interest", "vector"), items, k)


def with_fallback(candidates: DataFrame, users: DataFrame, fallback: DataFrame) -> DataFrame:
    """Users without candidates get the fallback's."""
    lost = users.select("user_id").join(candidates.select("user_id"), "user_id", "left_anti")
    return candidates.unionByName(fallback.join(lost, "user_id", "left_semi"))


def transitions(train: DataFrame, order: list[str], k: int = 20) -> DataFrame:
    """First-order successor counts of each user's last item."""
    w = W.partitionBy("user_id").orderBy(*order)
    moves = train.withColumn("next", F.lead("item_id").over(w)).where("next is not null").groupBy(F.col("item_id").alias("i"), F.col("next").alias("j")).agg(F.count("*").alias("c"))
    last = train.groupBy("user_id").agg(F.max_by("item_id", F.struct(*order)).alias("i"))
    scored = last.join(moves, "i").select("user_id", F.col("j").alias("item_id"), F.col("c").cast("double").alias("score"))
    return top_k(unseen(scored, train), k)


# fusion ------------------------------------------------------------------------------


def min_max(candidates: DataFrame) -> DataFrame:
    """Scores of each list on 0..1; a list of equal scores stays as it is."""
    w = W.partitionBy("user_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return candidates.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.col("score")))


def max_scaled(candidates: DataFrame) -> DataFrame:
    """Scores over each list's largest (1 if that isn't positive)."""
    high = F.max("score").over(W.partitionBy("user_id"))
    return candidates.withColumn("score", F.col("score") / F.when(high > 0, high).otherwise(F.lit(1.0)))


def weighted(first: DataFrame, second: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """weight x first + (1 - weight) x second; an item missing in one list scores 0 there."""
    part = lambda c, w: c.select("user_id", "item_id", (F.col("score") * w).alias("score"))
    both = part(first, weight).unionByName(part(second, 1 - weight))
    return top_k(both.groupBy("user_id", "item_id").agg(F.round(F.sum("score"), 9).alias("score")), k)


def reciprocal_ranks(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Sum over lists of 1 / (constant + rank)."""
    rows = lists[0].select("user_id", "item_id", "rank")
    for more in lists[1:]:
        rows = rows.unionByName(more.select("user_id", "item_id", "rank"))
    return top_k(rows.groupBy("user_id", "item_id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 12).alias("score")), k)


def quota(first: DataFrame, second: DataFrame, fill: DataFrame, k: int, share: float = 0.6) -> DataFrame:
    """share x k of the first list, then the rest from the second, then the fill; no item twice."""
    a = int(round(share * k))
    part = lambda c, n, s: c.where(F.col("rank") <= n).select("user_id", "item_id", F.lit(s).alias("source"), "rank")
    rows = part(first, a, 0).unionByName(second.select("user_id", "item_id", F.lit(1).alias("source"), "rank")).unionByName(fill.select("user_id", "item_id", F.lit(2).alias("source"), "rank"))
    once = W.partitionBy("user_id", "item_id").orderBy("source", "rank")
    rows = rows.withColumn("nth", F.row_number().over(once)).where("nth = 1")
    within = W.partitionBy("user_id", "source").orderBy("rank")
    rows = rows.withColumn("at", F.row_number().over(within)).where((F.col("source") != 1) | (F.col("at") <= k - a))
    w = W.partitionBy("user_id").orderBy("source", "rank", "item_id")
    rows = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return rows.select("user_id", F.col("place").cast("int").alias("rank"), "item_id", (1 / F.col("place")).alias("score"))


def votes(first: DataFrame, second: DataFrame, k: int, share: float = 0.6) -> DataFrame:
    """share for being in the first list, the rest for the second."""
    part = lambda c, v: c.select("user_id", "item_id", F.lit(v).alias("score"))
    rows = part(first, share).unionByName(part(second, 1 - share))
    return top_k(rows.groupBy("user_id", "item_id").agg(F.round(F.sum("score"), 9).alias("score")), k)
