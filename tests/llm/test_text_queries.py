import pytest
from oracle import assert_same

from joinloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), SF, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_one_row_per_document(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = QUERIES[name](spark, SF).select("doc_id").collect()
    assert len({r.doc_id for r in got}) == n and (len(got) == n or name.startswith("op8_"))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs.count(), docs.dtypes
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.dtypes == columns and 0 < docs.count() <= before
        before = docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == ids
