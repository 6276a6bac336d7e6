"""Plateau-then-jump detection on a metric trace, as streams with bounded state and as batches.

``leaps`` enters and leaves plateaus and asks for a lasting rise. ``jumps`` is a quicker rule
for deviations either way: a point is flat if, over the last ``window`` points, the standard deviation is below
``spread`` and the absolute trend below ``spread`` / ``patience``. When a flat stretch of
``patience`` points or more ends, the point that ends it is a jump if it lies more than
``z`` standard deviations from the stretch's mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    window: int = 20
    patience: int = 5
    spread: float = 0.5
    z: float = 2.0


JUMPS = "run_id long, step long, value double, flat_points long, z double"


def flat_points(trace: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Adds rolling deviation, trend and ``flat``. trace: run_id, step, value."""
    w = W.partitionBy("run_id").orderBy("step")
    last = w.rowsBetween(-(rule.window - 1), 0)
    rows = trace.withColumn("at", F.row_number().over(w)).withColumn("n", F.count("*").over(last))
    rows = rows.withColumn("sd", F.stddev_pop("value").over(last)).withColumn("trend", F.regr_slope("value", F.col("at").cast("double")).over(last))
    flat = (F.col("n") == rule.window) & (F.col("sd") < rule.spread) & (F.abs("trend") < rule.spread / rule.patience)
    return rows.withColumn("flat", F.coalesce(flat, F.lit(False)))


def jumps(trace: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The batch form: islands of flat points by a running count of the others."""
    w = W.partitionBy("run_id").orderBy("step")
    rows = flat_points(trace, rule).withColumn("island", F.sum((~F.col("flat")).cast("int")).over(w))
    plateaus = rows.where("flat").groupBy("run_id", "island").agg(F.count("*").alias("flat_points"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("dev"))
    ends = rows.where("not flat").select("run_id", "step", "value", (F.col("island") - 1).alias("island"))
    hit = ends.join(plateaus.where(F.col("flat_points") >= rule.patience), ["run_id", "island"])
    z = F.abs(F.col("value") - F.col("mean")) / (F.col("dev") + 1e-10)
    return hit.select("run_id", "step", "value", "flat_points", F.round(z, 6).alias("z")).where(F.col("z") > rule.z)


def _advance(state: dict[str, Any], step: int, value: float, rule: Rule) -> tuple[int, float, int, float] | None:
    recent = state["recent"]
    recent.append(value)
    del recent[: -rule.window]
    flat = False
    if len(recent) == rule.window:
        x, y = np.arange(rule.window) - (rule.window - 1) / 2, np.asarray(recent)
        flat = bool(y.std() < rule.spread and abs((x * (y - y.mean())).sum() / (x * x).sum()) < rule.spread / rule.patience)
    if flat:
        state["n"] += 1
        state["s"] += value
        state["q"] += value * value
        return None
    found = None
    if state["n"] >= rule.patience:
        mean = state["s"] / state["n"]
        z = abs(value - mean) / (max(0.0, state["q"] / state["n"] - mean * mean) ** 0.5 + 1e-10)
        if z > rule.z:
            found = (step, value, state["n"], round(z, 6))
    state["n"], state["s"], state["q"] = 0, 0.0, 0.0
    return found


def stream_jumps(trace: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The streaming form: state per run is ``window`` values and the sums of the open stretch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, n, s, q = state.get if state.exists else ([], 0, 0.0, 0.0)
        now = {"recent": list(recent), "n": n, "s": s, "q": q}
        rows = pd.concat(list(batches)).sort_values("step")
        out = [(key[0], *hit) for step, value in zip(rows["step"], rows["value"], strict=True) if (hit := _advance(now, int(step), float(value), rule))]
        state.update((now["recent"], now["n"], now["s"], now["q"]))
        yield pd.DataFrame(out, columns=["run_id", "step", "value", "flat_points", "z"])

    return trace.groupBy("run_id").applyInPandasWithState(update, JUMPS, "recent array<double>, n long, s double, q double", "append", GroupStateTimeout.NoTimeout)


def epoch_jumps(trace: DataFrame, last: int = 10, variance: float = 1e-4, jump: float = 0.05) -> DataFrame:
    """The first point per run that lies ``jump`` above the mean of the ``last`` quiet points before it."""
    w = W.partitionBy("run_id").orderBy("step").rowsBetween(-last, -1)
    rows = trace.withColumn("n", F.count("*").over(w)).withColumn("mean", F.avg("value").over(w)).withColumn("var", F.var_pop("value").over(w))
    return rows.where((F.col("n") == last) & (F.col("var") < variance) & (F.col("value") - F.col("mean") > jump)).groupBy("run_id").agg(F.min("step").alias("step"))


def emergence(trace: DataFrame, last: int = 9, least: int = 5, rise: float = 0.1) -> DataFrame:
    """Points that exceed the mean of the ``last`` before them by ``rise``, given ``least`` points of history."""
    w = W.partitionBy("run_id").orderBy("step").rowsBetween(-last, -1)
    rows = trace.withColumn("n", F.count("*").over(w)).withColumn("rise", F.col("value") - F.avg("value").over(w))
    return rows.where((F.col("n") >= least) & (F.col("rise") > rise)).select("run_id", "step", F.round("rise", 6).alias("rise"))


def half_jump(trace: DataFrame, window: int = 500) -> DataFrame:
    """run_id and the z-score of the later half of the last ``window`` points against the earlier half."""
    back = W.partitionBy("run_id").orderBy(F.desc("step"))
    rows = trace.withColumn("back", F.row_number().over(back)).where(F.col("back") <= window)
    late = F.col("back") <= window // 2
    v = F.col("value")
    g = rows.groupBy("run_id").agg(F.avg(F.when(late, v)).alias("late"), F.avg(F.when(~late, v)).alias("early"), F.stddev_pop(F.when(~late, v)).alias("sd"))
    return g.select("run_id", F.round((F.col("late") - F.col("early")) / (F.col("sd") + 1e-10), 6).alias("z"))


@dataclass(frozen=True)
class LeapRule:
    """``window`` points before anything is judged, twice as many remembered; plateaus of ``patience``, in points to be
    recognised and in steps to count; ``z`` deviations of rise; the last ``sustain`` points must not fall."""

    window: int = 500
    delta: float = 0.05
    patience: int = 200
    z: float = 2.0
    sustain: int = 100

    def __post_init__(self) -> None:
        if not 2 <= self.patience <= 2 * self.window:
            raise ValueError("patience lies between 2 and twice the window")

    @property
    def late(self) -> int:
        """Points that are held against those before them."""
        return (self.window + 1) // 2


LEAPS = "run_id long, plateau_start long, step long, duration long, before double, after double"


def leaps(trace: DataFrame, rule: LeapRule = LeapRule()) -> DataFrame:
    """Ends of plateaus that rise: run_id, plateau_start, step, duration, before, after. trace: run_id, step, value.

    A run is on a plateau where its last ``patience`` points neither spread by ``delta`` nor
    trend by ``delta / patience``. The step that leaves one is a leap if it lasted ``patience``
    steps, the later half window exceeds what came before by ``z`` deviations (10 points a
    side, deviation not under 1e-6), and the last ``sustain`` points don't decline. before is
    the value one window ago. Steps of a run are distinct; null values are left out.
    """
    w = W.partitionBy("run_id").orderBy("step")
    back = lambda far, near=0: w.rowsBetween(1 - far, -near)
    rest, late, tail, early = back(rule.patience), back(rule.late), back(rule.sustain), back(2 * rule.window, rule.late)
    slope = lambda over: F.coalesce(F.regr_slope("value", "at").over(over), F.lit(0.0))
    rows = trace.where("value is not null").select("run_id", "step", "value", F.row_number().over(w).cast("double").alias("at"))
    rows = rows.select(
        "run_id", "step", "value", F.lag("value", rule.window - 1).over(w).alias("before"),
        ((F.col("at") >= rule.window) & (F.stddev_pop("value").over(rest) < rule.delta) & (F.abs(slope(rest)) < rule.delta / rule.patience)).alias("flat"),
        F.avg("value").over(late).alias("now"), F.avg("value").over(early).alias("base"), F.stddev_pop("value").over(early).alias("dev"), F.count("value").over(early).alias("n"),
        ((F.col("at") < rule.sustain) | (slope(tail) >= -rule.delta / rule.sustain) | F.lit(rule.sustain > 2 * rule.window)).alias("holds"),
    )
    rows = rows.withColumn("was", F.coalesce(F.lag("flat").over(w), F.lit(False)))
    rows = rows.withColumn("plateau_start", F.last(F.when(F.col("flat") & ~F.col("was"), F.col("step")), ignorenulls=True).over(w))
    rises = (F.col("n") >= 10) & F.lit(rule.late >= 10) & (F.col("dev") >= 1e-6) & ((F.col("now") - F.col("base")) / F.col("dev") > rule.z)
    left = rows.where(~F.col("flat") & F.col("was") & (F.col("step") - F.col("plateau_start") >= rule.patience) & rises & F.col("holds"))
    return left.select("run_id", "plateau_start", "step", (F.col("step") - F.col("plateau_start")).alias("duration"), "before", F.col("value").alias("after"))


def _trend(y: np.ndarray) -> float:
    x = np.arange(len(y)) - (len(y) - 1) / 2
    return float((x * (y - y.mean())).sum() / (x * x).sum()) if len(y) > 1 else 0.0


def _rises(seen: np.ndarray, rule: LeapRule) -> bool:
    early, late = seen[: -rule.late], seen[-rule.late :]
    if min(len(early), len(late)) < 10 or early.std() < 1e-6 or (late.mean() - early.mean()) / early.std() <= rule.z:
        return False
    return len(seen) < rule.sustain or _trend(seen[-rule.sustain :]) >= -rule.delta / rule.sustain


def stream_leaps(trace: DataFrame, rule: LeapRule = LeapRule()) -> DataFrame:
    """``leaps`` as a stream. State per run: its last two windows of values and where the open plateau began.

    Steps of a run arrive in order from one batch to the next, in any order within one.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, flat, begin = state.get if state.exists else ([], False, 0)
        rows = pd.concat(list(batches)).dropna(subset=["value"]).sort_values("step")
        values, offset, found = np.concatenate([np.asarray(recent, float), rows["value"].to_numpy(float)]), len(recent), []
        for i, step in enumerate(rows["step"].tolist(), offset + 1):
            seen = values[max(0, i - 2 * rule.window) : i]
            rest = seen[-rule.patience :]
            now = bool(len(seen) >= rule.window and rest.std() < rule.delta and abs(_trend(rest)) < rule.delta / rule.patience)
            if flat and not now and step - begin >= rule.patience and _rises(seen, rule):
                found.append((key[0], begin, step, step - begin, float(seen[-rule.window]), float(seen[-1])))
            flat, begin = now, (step if now and not flat else begin)
        state.update((values[-2 * rule.window :].tolist(), flat, begin))
        yield pd.DataFrame(found, columns=["run_id", "plateau_start", "step", "duration", "before", "after"])

    return trace.groupBy("run_id").applyInPandasWithState(update, LEAPS, "recent array<double>, flat boolean, begin long", "append", GroupStateTimeout.NoTimeout)
