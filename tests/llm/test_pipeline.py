"""The pipeline's stages take effect on odd rows, and on the sample tables."""

import random

import corpus_pipeline
from tessella.llm._session import table

from .conftest import prose

SF = "/root/testdata/sf0.01"


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = table(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
    ids = [r["doc_id"] for r in docs.collect()]
    assert ids.count(6) <= 1 and None in ids and 1 in ids and 5 not in ids
    out = corpus_pipeline.to_tokens(spark, docs, SF)
    assert out.count() == len(ids)


def test_near_duplicates_from_four_fifths_on(spark, make_docs):
    words = [f"w{i}" for i in range(100)]
    other = ["x" if i in (30, 60) else w for i, w in enumerate(words)]  # 86 of 106 shingles are shared
    docs = make_docs([(1, " ".join(words)), (2, " ".join(other))])
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()] == [1]


def test_texts_of_one_id(spark, make_docs):
    rng = random.Random(6)
    a, b, c = (prose(rng, 100) for _ in range(3))
    docs = make_docs([(5, a), (5, b), (5, b), (9, b + " more"), (3, a + " more"), (7, c), (None, a)])
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([(5, b), (3, a + " more"), (7, c), (None, a)], key=str)


def test_empty_table(spark, make_docs):
    docs = make_docs([])
    for name, stage in corpus_pipeline.STAGES:
        docs = table(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.6 * n < out.count() < n
    assert out.where("n_tokens != size(ids)").count() == 0
