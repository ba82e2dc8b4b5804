"""The corpus pipeline and the registered queries on the small tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from quarrymill.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        left = docs.count()
        assert 0 < left <= n, name
        n = left
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert "text" in mixed.columns and 0 < mixed.select("doc_id").distinct().count() <= n


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    want = con.sql(queries.oracle_sql()[name])
    out = queries.queries()[name](spark, DATA)
    assert sorted(out.columns) == sorted(want.columns)
    order = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in out.select(*want.columns).collect()), key=order) == sorted(want.fetchall(), key=order)
