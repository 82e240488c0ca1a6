"""Registered text queries: SQL where there is one, rows and invariants otherwise."""

import duckdb
import pytest

import parity
from __spark_entry__ import oracle_sql, queries
from brickyard.llm import catalog
from conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    problem, *_ = parity.compare(spark, parity.duck(SF), SF, name, queries()[name], oracle_sql()[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows(spark, name):
    rows = queries()[name](spark, SF)
    documents = duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    assert rows.select("doc_id").distinct().count() == documents


def test_pipeline_equals_its_stages_one_by_one(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    from brickyard.llm.common import stage
    for n, (_, step) in enumerate(corpus_pipeline.STAGES):
        docs = stage(step(spark, docs, SF), "test-stage")
        if n < 4:
            assert docs.columns == columns
            kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    own = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, docs.collect()))
    assert own.select("doc_id").distinct().count() == kept[-1]
