"""The corpus pipeline against its stages' brute force on a small folder."""

import random

import pytest

import corpus_pipeline
from stagewise.llm import queries
from tests.llm.test_corpus_operators import _brute_components, _brute_contamination


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(6)
    words = ["the", "of", "and", "stone", "river", "with", "token", "light", "cold", "house"]
    text = lambda n: " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(n))
    rows = [(i, text(r.randint(20, 80)), "en", "s", 0) for i in range(40)]
    rows += [(40, rows[3][1] + " x", "en", "s", 0), (41, "?? !! 123", None, "s", 0), (42, None, "en", "s", 0), (43, "write to ann@mail.example.com now " + text(30), "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, rows[7][1])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_pipeline(spark, folder):
    path, rows = folder
    left = [(i, t) for i, t, *_ in rows if i not in (41, 42)]
    first = {i for i, (_, c) in _brute_components(left, 5).items() if i == c}
    dirty = {i for i, v in _brute_contamination([(i, t) for i, t in left if i in first], [(1, rows[7][1])]).items() if v[4]}
    got = corpus_pipeline.run(spark, path).toPandas()
    assert set(got["doc_id"]) == first - dirty and 7 in dirty and 40 not in first
    assert (got.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_each_stage_keeps_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder[0]).count() == 0, name
    clean = corpus_pipeline.take_out_personal_data(spark, docs, folder[0]).where("doc_id = 43").first()
    assert "<EMAIL>" in clean.text and clean.n_chars == len(clean.text)


def test_registered_queries():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
