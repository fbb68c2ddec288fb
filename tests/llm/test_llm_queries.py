"""Registered queries against their SQL, and the pipeline's stages against plain versions."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from curbline.llm import decontaminate, ngram_join, oracles, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = queries.QUERIES[name](spark, str(DATA))
    rel = con.sql(oracles.ORACLES[name])
    columns = sorted(df.columns)
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = step(spark, before, str(DATA)).cache()
        assert docs.columns == corpus_pipeline.COLUMNS and 0 < docs.count() <= before.count()
        if name == "ngram_join":
            again = ngram_join.join_classes(docs, words=5, percent=80)
            assert again.filter("component_id <> doc_id").count() == 0
        if name == "decontaminate":
            assert decontaminate.find(docs, spark.read.parquet(str(DATA / "benchmark.parquet"))).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert last.count() == docs.count()
