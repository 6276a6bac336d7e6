"""Lists mixed in batches, and communities without listed links."""

import numpy as np
from pyspark.sql import functions as F

from stagewise.operators import graph, rerank


def test_lists_of_many_lengths_mixed_at_once(spark):
    r = np.random.Generator(np.random.PCG64(7))
    rows = [(u, 100 * u + i, i + 1, float(1 - i / 9), None if r.random() < 0.3 else float(r.random()), int(r.integers(0, 50))) for u in range(12) for i in range(1 + u % 5)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rank int, score double, cosine double, pop long").repartition(3)
    got = rerank.attention_smoothed(df)
    assert "mapInArrow" in got._jdf.queryExecution().toString() or "MapInArrow" in got._jdf.queryExecution().toString()
    lists = {u: [x for x in rows if x[0] == u] for u in range(12)}
    want = []
    for user, own in lists.items():
        q = np.array([[s, c, np.log1p(p), 1 / (i + 1), i / len(own)] if c is not None else [0] * 5 for i, (_, _, _, s, c, p) in enumerate(own)], float)
        a = np.exp(z := q @ q.T / np.sqrt(5)) / 1
        a = np.exp(z - z.max(axis=1, keepdims=True))
        final = ((a / (a.sum(axis=1, keepdims=True) + 1e-10)) @ q)[:, :4] @ np.array(rerank.ATTENDED)
        want += [(user, n, own[i][1]) for n, i in enumerate(np.argsort(-final.round(9), kind="stable"), 1)]
    assert sorted(tuple(x) for x in got.collect()) == sorted((u, int(n), i) for u, n, i in want)


def test_communities_find_separate_groups_and_leave_out_loners(spark):
    pairs = [(u, 10 * (u // 10) + i) for u in range(30) for i in range(5)] + [(99, 999)]
    df = spark.createDataFrame(pairs, "user_id long, item_id long")
    got = {r.user_id: r.community for r in graph.communities(df, 3, 8).collect()}
    assert set(got) == set(range(30)) and len(set(got.values())) == 3
    assert all(len({got[u] for u in range(g, g + 10)}) == 1 for g in (0, 10, 20))
    assert got == {r.user_id: r.community for r in graph.communities(df.repartition(5), 3, 8).collect()}
    assert graph.communities(df.where(F.lit(False)), 3).count() == 0
