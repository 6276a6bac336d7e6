"""A learned gate over experts: softmax of a linear map, the best k with weights renormalised, usage kept balanced.

Training maximises the mean reward of the experts as the gate weighs them, less ``balance``
times the divergence of the mean usage from an even one. All its sums are over rows for given
weights: a step is one pass in which every task adds up matrix products, and Spark adds the
tasks. What reaches the driver is experts x experts x features numbers, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """One row of weights an expert; the last weight of each is its bias."""

    weights: tuple[tuple[float, ...], ...]


def shares(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Softmax a row, of features with a last column of ones."""
    z = x @ weights.T
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sums(x: np.ndarray, rewards: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows, reward, usage, and the three sums that the gradient is made of, in one array."""
    p = shares(x, weights)
    gain = (p * rewards).sum(1, keepdims=True)
    pull = (p * (rewards - gain)).T @ x
    crossed = np.einsum("ie,ij,id->ejd", p, p, x, optimize=True)
    return np.concatenate([[len(x), gain.sum()], p.sum(0), pull.ravel(), (p.T @ x).ravel(), crossed.ravel()])


def gradient(total: np.ndarray, experts: int, width: int, balance: float) -> tuple[float, np.ndarray]:
    """Objective (to be raised) and its gradient from the sums over all rows."""
    n, size = total[0], experts * width
    usage = total[2 : 2 + experts] / n
    at = 2 + experts
    pull, own, crossed = total[at : at + size], total[at + size : at + 2 * size], total[at + 2 * size :]
    even = 1 / experts
    press = even / usage  # each expert's share of the divergence falls as its usage rises
    crossed = crossed.reshape(experts, experts, width)
    evening = press[:, None] * own.reshape(experts, width) - np.tensordot(press, crossed, 1)
    divergence = float((even * np.log(even / usage)).sum())
    return float(total[1] / n) - balance * divergence, (pull.reshape(experts, width) + balance * evening) / n


def train_gate(rows: DataFrame, features: str, rewards: str, steps: int = 30, rate: float = 1.0, balance: float = 0.01) -> tuple[Gate, list[float]]:
    """The gate after ``steps`` of ascent from even shares, and the objective before each step.

    rows: arrays ``features`` and ``rewards`` (one an expert), all of one length; rows with a
    null array are left out. Without rows there is nothing to learn: ValueError.
    """
    from stagewise.functions.lineage import cut

    rows = cut(rows.select(F.col(features).alias("x"), F.col(rewards).alias("y")).where("x is not null and y is not null"))
    one = rows.select(F.size("x").alias("d"), F.size("y").alias("e")).head()
    if one is None:
        raise ValueError("no rows to train a gate on")
    width, experts = one.d + 1, one.e
    weights, course = np.zeros((experts, width)), []
    for _ in range(steps):
        now = weights.copy()

        def add(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            total = None
            for b in batches:
                if len(b):
                    x = np.column_stack([np.array(b["x"].tolist(), float).reshape(len(b), width - 1), np.ones(len(b))])
                    part = sums(x, np.array(b["y"].tolist(), float), now)
                    total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"at": range(len(total)), "v": total})

        total = rows.mapInPandas(add, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")["v"].to_numpy()
        value, slope = gradient(total, experts, width, balance)
        course.append(value)
        weights = weights + rate * slope
    return Gate(tuple(tuple(w) for w in weights.tolist())), course


def gate_shares(features: Column, gate: Gate) -> Column:
    """Softmax shares of all experts, as an array."""
    logits = F.array(*[sum((features[i] * F.lit(w) for i, w in enumerate(row[:-1])), F.lit(row[-1])) for row in gate.weights])
    powers = F.transform(F.array(logits), lambda z: F.transform(z, lambda v: F.exp(v - F.array_max(z))))[0]
    return F.transform(F.array(powers), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, x: s + x)))[0]


def route(rows: DataFrame, features: str, gate: Gate, k: int = 2) -> DataFrame:
    """Adds ``experts``, the k of largest share (ties to the first), and their ``weights``, which sum to one; null of null features."""
    taken = [c for c in ("experts", "weights") if c in rows.columns]
    if taken:
        raise ValueError(f"columns exist already: {taken}")
    ranked = F.transform(gate_shares(F.col(features), gate), lambda p, e: F.struct((-p).alias("p"), e.alias("e")))
    best = rows.withColumn("stagewise_best", F.when(F.col(features).isNotNull(), F.slice(F.array_sort(ranked), 1, k)))
    whole = F.aggregate("stagewise_best", F.lit(0.0), lambda s, b: s - b["p"])
    return best.withColumn("experts", F.transform("stagewise_best", lambda b: b["e"])).withColumn("weights", F.transform("stagewise_best", lambda b: -b["p"] / whole)).drop("stagewise_best")


def usage_entropy(routed: DataFrame) -> DataFrame:
    """expert, rows sent to it and weight, with the entropy of the weights over all experts used."""
    sent = routed.select(F.explode(F.arrays_zip("experts", "weights")).alias("r")).groupBy(F.col("r.experts").alias("expert")).agg(F.count("*").alias("n"), F.sum("r.weights").alias("weight"))
    total = sent.agg(F.sum("weight").alias("all"))
    g = sent.join(F.broadcast(total)).withColumn("p", F.col("weight") / F.col("all"))
    return g.join(F.broadcast(g.agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy")))).select("expert", "n", "weight", "entropy")


def mixture(scores: DataFrame, routed: DataFrame, key: str = "user_id") -> DataFrame:
    """Candidates with the score of their user's experts by weight. scores: key, item_id and an array ``scores`` (one an expert)."""
    ways = routed.select(key, F.arrays_zip("experts", "weights").alias("ways"))
    score = F.aggregate("ways", F.lit(0.0), lambda s, w: s + w["weights"] * F.get(F.col("scores"), w["experts"]))
    return scores.join(ways, key).select(key, "item_id", score.alias("score"))
