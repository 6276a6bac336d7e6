"""The learned gate: gradients by differences, shares and mixtures by loops, what balance does."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagewise.operators import gate

ROWS = "user_id long, x array<double>, y array<double>"


def _objective(x, y, weights, balance):
    p = gate.shares(x, weights)
    used = p.mean(0)
    return (p * y).sum(1).mean() - balance * sum(math.log(1 / len(used) / u) / len(used) for u in used)


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    x, y, w = np.column_stack([rng.normal(size=(30, 2)), np.ones(30)]), rng.random((30, 4)), rng.normal(size=(4, 3))
    value, slope = gate.gradient(gate.sums(x[:11], y[:11], w) + gate.sums(x[11:], y[11:], w), 4, 3, 0.3)
    assert value == pytest.approx(_objective(x, y, w, 0.3))
    for e in range(4):
        for d in range(3):
            up, down = w.copy(), w.copy()
            up[e, d] += 1e-5
            down[e, d] -= 1e-5
            assert slope[e, d] == pytest.approx((_objective(x, y, up, 0.3) - _objective(x, y, down, 0.3)) / 2e-5, abs=1e-8)


def _rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    y = np.column_stack([x[:, 0] > 0, x[:, 0] <= 0, np.full(200, 0.3)]).astype(float)
    return spark.createDataFrame([(u, a, b) for u, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))], ROWS)


def test_learns_who_is_good_where(spark):
    rows = _rows(spark)
    learned, course = gate.train_gate(rows, "x", "y", steps=25, rate=4.0, balance=0.01)
    assert course == sorted(course) and course[-1] > course[0] + 0.2
    again, _ = gate.train_gate(rows.repartition(5), "x", "y", steps=25, rate=4.0, balance=0.01)
    assert np.allclose(learned.weights, again.weights)
    routed = gate.route(rows, "x", learned, 1)
    assert routed.agg(F.avg(F.get("y", F.col("experts")[0]))).first()[0] > 0.95
    even, _ = gate.train_gate(rows, "x", "y", steps=25, rate=4.0, balance=1.0)
    third = lambda g: rows.agg(F.avg(gate.gate_shares(F.col("x"), g)[2])).first()[0]
    assert third(even) > third(learned) + 0.05  # the poor expert is kept in use
    with pytest.raises(ValueError):
        gate.train_gate(rows.where("false"), "x", "y")


def test_route_and_mixture_by_loops(spark):
    g = gate.Gate(((0.5, -1.0, 0.1), (0.5, -1.0, 0.1), (2.0, 0.0, -1.0), (-300.0, 900.0, 0.0)))
    rows = spark.createDataFrame([(1, [0.2, 0.1], None), (2, [1.0, -1.0], None), (3, [0.0, 0.0], None), (4, None, None)], ROWS)
    routed = gate.route(rows, "x", g, 2)
    got = {r.user_id: (r.experts, r.weights) for r in routed.collect()}
    for u, x in ((1, [0.2, 0.1]), (2, [1.0, -1.0]), (3, [0.0, 0.0])):
        p = gate.shares(np.array([[*x, 1.0]]), np.array(g.weights))[0]
        best = sorted(range(4), key=lambda e: (-p[e], e))[:2]
        assert got[u][0] == best
        assert got[u][1] == pytest.approx(p[best] / p[best].sum())
    assert got[4] == (None, None)
    scores = spark.createDataFrame([(u, 7, [1.0, 2.0, 4.0, 8.0]) for u in (1, 2, 3)], "user_id long, item_id long, scores array<double>")
    for r in gate.mixture(scores, routed).collect():
        assert r.score == pytest.approx(sum(w * 2.0**e for e, w in zip(*got[r.user_id], strict=True)))
    used = gate.usage_entropy(routed.where("x is not null")).collect()
    assert sum(r.n for r in used) == 6 and sum(r.weight for r in used) == pytest.approx(3.0)
    assert used[0].entropy == pytest.approx(-sum(r.weight / 3 * math.log(r.weight / 3) for r in used))
    with pytest.raises(ValueError):
        gate.route(routed, "x", g)
