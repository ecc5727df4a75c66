"""The registered queries and the pipeline on the smallest tables."""

import pytest
from check import compare, duck

import corpus_pipeline
from plotwise.llm.common import documents
from plotwise.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    table = spark.read.parquet(f"{SF}/pages.parquet") if name.startswith("op4_") else documents(spark, SF)
    if name.startswith("op6_"):
        assert df.select("doc_id").distinct().count() == table.count()
    elif name.startswith("op13_"):
        assert df.groupBy("item_id").count().filter("count > 50").isEmpty() and not df.isEmpty()
    else:
        assert df.count() == table.count()
    if name in ORACLE:
        assert compare(df, duck(SF), ORACLE[name]) is None


def test_pipeline_stages(spark, tmp_path):
    docs = documents(spark, SF)
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        kept = {r.doc_id for r in docs.collect()}
        assert kept and kept <= ids
        ids = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == ids


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
