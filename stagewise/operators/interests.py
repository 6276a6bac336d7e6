"""Several interests a user, by routing the vectors of its last items to capsules.

Every item of a history has a share in every capsule (softmax of its logits). A capsule
is the shared sum of its items' vectors, its length squashed below 1; items whose vectors
agree with a capsule gain a larger share of it in the next round. Logits begin with
small numbers that follow from item and capsule: equal ones would leave all capsules
equal.

Defined results: items without a vector don't count, users without any are left out; a
history counts with its ``last`` items (most recent, then larger item_id), repeated ones
as often as they stand there; an empty history table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagewise.operators.blocks import best_by_passes
from stagewise.operators.pairwise import first_vectors
from stagewise.operators.retrieve import own_items


def squashed(s: np.ndarray) -> np.ndarray:
    """Vectors of the same direction and length n^2 / (1 + n^2)."""
    n = np.sqrt((s * s).sum(axis=-1, keepdims=True))
    return n**2 / (1 + n**2) * (s / (n + 1e-8))


def route(vectors: np.ndarray, logits: np.ndarray, rounds: int) -> np.ndarray:
    """Capsules (n x d) of one history: vectors (items x d), first logits (items x n)."""
    for turn in range(rounds):
        share = np.exp(logits - logits.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        capsules = squashed(share.T @ vectors)
        if turn < rounds - 1:
            logits = logits + vectors @ capsules.T
    return capsules


def interests(history: DataFrame, vectors: DataFrame, n: int = 4, rounds: int = 3, last: int = 50, seed: int = 42) -> DataFrame:
    """user_id, capsule, vector. history: user_id, item_id, back (1 is the last); vectors: item_id, vector."""
    rows = packed_interests(history, vectors, n, rounds, last, seed)
    width = (F.size("vectors") / n).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.slice("vectors", c * width + 1, width))
    return rows.select("user_id", F.posexplode(each).alias("capsule", "vector"))


def packed_interests(history: DataFrame, vectors: DataFrame, n: int = 4, rounds: int = 3, last: int = 50, seed: int = 42) -> DataFrame:
    """user_id, vectors: the capsules of a user, one after the other."""
    own = history.join(vectors.select("item_id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null"), "item_id")
    w = W.partitionBy("user_id").orderBy("back", F.desc("item_id"))
    own = own.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= last)
    packed = own.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("nth", "item_id", "vector"))).alias("r"))
    packed = packed.select("user_id", F.transform("r", lambda x: x["item_id"]).alias("items"), F.flatten(F.transform("r", lambda x: x["vector"])).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            capsules = []
            for items, x in zip(pdf["items"], pdf["x"], strict=True):
                items = np.asarray(items, np.int64)
                capsules.append(route(np.asarray(x, np.float64).reshape(len(items), -1), first_vectors(items, 2, n, seed), rounds).ravel())
            yield pd.DataFrame({"user_id": pdf["user_id"], "vectors": capsules})

    return packed.mapInPandas(run, "user_id long, vectors array<double>")


def multi_interest(history: DataFrame, vectors: DataFrame, k: int = 100, own: DataFrame | None = None, **options: int) -> DataFrame:
    """The best k unmet items of each user: an item counts with the interest it fits best. own: user_id, own (items), where it is at hand."""
    return best_by_passes(packed_interests(history, vectors, **options), vectors, k, exclude=own_items(history) if own is None else own)
