"""Queries of this subpackage against their SQL, and the pipeline's stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from motioncheck.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    found = queries.queries()[name](spark, DATA)
    want = duck.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert columns == sorted(found.columns)
    assert sorted(str(tuple(r)) for r in found.select(columns).collect()) == sorted(str(r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        assert out.columns == first.columns
        assert 0 < out.count() <= docs.count(), name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    # pieces depend on how documents are dealt to tasks; their ids don't
    tokens = lambda df: {r.doc_id: r.n for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert tokens(corpus_pipeline.run(spark, DATA)) == tokens(packed)


def test_pipeline_keeps_clean_documents(spark):
    texts = [(i, " ".join(f"the word{i}x{j} and of in that is" for j in range(40)), "en", "s", 1) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = {r.doc_id: r.text for r in stage(spark, docs, DATA).collect()}
        assert kept == {t[0]: t[1] for t in texts}, name
