"""The registered queries and the pipeline on the smallest tables."""

import os

import pytest

import corpus_pipeline
import oracle
from strandframe.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pipeline" and not n.startswith(("op11_", "op13_"))])
def test_query_covers_the_table(spark, name):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    keys = QUERIES[name](spark, SF_DIR).select("doc_id").distinct()
    assert keys.count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, SF_DIR), oracle.connect(SF_DIR), ORACLES[name]) is None


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()
    columns, before = docs.columns, docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR).cache()
        assert out.columns == columns and 0 < out.count() <= before, name
        if name != "PII":
            assert all(texts[r["doc_id"]] == r["text"] for r in out.select("doc_id", "text").collect())
        docs, before = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_take_nothing(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).where("offset + length > 2048").isEmpty()
