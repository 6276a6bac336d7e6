"""Interest routing against plain loops."""

import math

import numpy as np

from stagewise.operators import interests
from stagewise.operators.pairwise import first_vectors


def _rows(seed=4):
    r = np.random.Generator(np.random.PCG64(seed))
    vectors = [(i, [float(x) for x in np.round(r.normal(size=3), 3)]) for i in range(12)]
    history = [(u, int(i), b) for u in range(6) for b, i in enumerate(r.permutation(14)[: 3 + u], 1)]
    return vectors, history


def _plain(items, vectors, n, rounds):
    logits = [list(row) for row in first_vectors(np.array(items), 2, n, 42)]
    for turn in range(rounds):
        shares = [[math.exp(x) / sum(map(math.exp, row)) for x in row] for row in logits]
        capsules = []
        for c in range(n):
            s = [sum(shares[i][c] * vectors[item][d] for i, item in enumerate(items)) for d in range(3)]
            size = math.sqrt(sum(x * x for x in s))
            capsules.append([size**2 / (1 + size**2) * x / (size + 1e-8) for x in s])
        if turn < rounds - 1:
            for i, item in enumerate(items):
                for c in range(n):
                    logits[i][c] += sum(a * b for a, b in zip(capsules[c], vectors[item], strict=True))
    return capsules


def test_routing_equals_loops(spark):
    vectors, history = _rows()
    h = spark.createDataFrame(history, "user_id long, item_id long, back int").repartition(3)
    v = spark.createDataFrame([*vectors, (13, None)], "item_id long, vector array<double>")
    got = {(r.user_id, r.capsule): r.vector for r in interests.interests(h, v, n=3, rounds=3, last=4).collect()}
    known = dict(vectors)
    for user in range(6):
        items = [i for u, i, _ in history if u == user and i in known][:4]
        for c, want in enumerate(_plain(items, known, 3, 3)):
            assert np.allclose(got[user, c], want)
    assert len(got) == 18
    assert not np.allclose(got[5, 0], got[5, 1])


def test_candidates_are_unmet_and_best(spark):
    vectors, history = _rows()
    h = spark.createDataFrame(history, "user_id long, item_id long, back int")
    v = spark.createDataFrame(vectors, "item_id long, vector array<double>")
    capsules: dict = {}
    for r in interests.interests(h, v, n=3).collect():
        capsules.setdefault(r.user_id, []).append(r.vector)
    got = {}
    for r in interests.multi_interest(h, v, 2, n=3).collect():
        got.setdefault(r.user_id, []).append((-r.score, r.item_id))
    for user, own in capsules.items():
        met = {i for u, i, _ in history if u == user}
        want = sorted((-round(max(float(np.dot(c, x)) for c in own), 9), i) for i, x in vectors if i not in met)[:2]
        assert np.allclose(sorted(got.get(user, [])), want)
    assert interests.interests(h.limit(0), v).count() == 0
