"""Bytes that queries shuffle on the smallest tables: lists and pairs of items must not become rows that are dealt anew."""

import time

import pytest

import __spark_entry__ as entry
from stagewise.operators import retrieve

SF = "/root/testdata/sf0.001"

#: Query and bytes allowed; what was shuffled before is behind each.
BOUNDS = {
    "knn_minmax": 400_000,  # 1,399,600
    "itemknn_top50": 400_000,  # 1,399,600
    "itemknn_profile": 400_000,  # 907,886
    "full_score_average": 400_000,  # 3,483,770
    "cooc_window": 400_000,  # 1,632,665
    "itemknn_full": 400_000,  # 1,572,225
    "ltr_pairwise_lr": 600_000,  # 2,610,364
    "ltr_leak_protocols": 600_000,  # 4,041,053
    "ltr_logistic": 600_000,  # 2,592,504
    "sft_examples": 400_000,  # 1,403,840
    "ranknet_pairs": 400_000,  # 1,105,337
    "density_sweep": 400_000,  # 1,094,787
    "ltr_groups": 400_000,  # 1,100,689
}


@pytest.mark.parametrize("name", BOUNDS)
def test_bytes_shuffled(spark, name):
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: store.executorSummary("driver").totalShuffleWrite()
    time.sleep(0.5)
    before = written()
    entry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    time.sleep(0.5)
    assert written() - before <= BOUNDS[name]


def test_lists_of_short_and_long_histories(spark):
    counts = {i: 1 + i % 7 for i in range(1, 1300)}
    own = {1: [], 2: [6, 13], 3: list(range(1, 1150))}
    c = spark.createDataFrame(list(counts.items()), "item_id long, n long")
    u = spark.createDataFrame([(x, y, x * 10) for x, y in own.items()], "user_id long, own array<long>, other long")
    got = {r.user_id: r for r in retrieve.popular_lists(u, c, 5).collect()}
    for user, met in own.items():
        want = sorted((-n, i) for i, n in counts.items() if i not in met)[:5]
        assert [(x.item_id, x.pop, x.score) for x in got[user]["list"]] == [(i, -n, -n / 7) for n, i in want] and got[user].other == user * 10
    rows = retrieve.unrolled(retrieve.popular_lists(u, c, 5), "other", "n", "pop")
    assert rows.columns == ["user_id", "rank", "item_id", "score", "other", "n", "pop"] and rows.where("n = 5 and rank = 5").count() == 3


def test_equal_texts_are_scored_once(spark):
    items = spark.range(2000).selectExpr("id AS item_id", "concat('word', id % 10, ' tail') AS text")
    asked = spark.range(300).selectExpr("id AS query_id", "concat('word', id % 10) AS text")
    got = retrieve.bm25(items, asked)
    assert got.count() == 300 * 200
    # a row of each answer was dealt by query and item before
    assert "hashpartitioning(query_id" not in got._jdf.queryExecution().executedPlan().toString()
