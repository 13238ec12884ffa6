"""The registered queries: those with SQL against DuckDB, the others by shape; the stages of the pipeline."""

import pytest

import corpus_pipeline
from sluice.llm import queries
from sluice.llm.tables import cut
from tests.oracle import connect, normalise


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    got = normalise(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf).execute(queries.SQL[name])
    assert got == normalise([d[0] for d in rel.description], rel.fetchall())
    assert got[1]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_covers_documents(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    if name != "op5_secrets":
        assert df.select("doc_id").distinct().count() == documents.count()
    assert df.count() > 0


def test_pipeline(spark, sf):
    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf), "stage")
        assert docs.columns == start.columns and docs.dtypes == start.dtypes, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] > 0
    last = cut(corpus_pipeline.STAGES[-1][1](spark, docs, sf), "stage")
    assert last.select("doc_id").distinct().count() == sizes[4]
    assert last.where("NOT restored").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == last.count()


def test_pipeline_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf), "stage")
        assert docs.count() == 0
