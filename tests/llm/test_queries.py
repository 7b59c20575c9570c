"""The registered queries and the pipeline over the smallest tables."""

import pytest
from oracle import SF, assert_same, connection

import corpus_pipeline
from lanternlog.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], connection())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    """run() against its stages by hand; packed documents are those that every stage keeps, with all their tokens."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = set(docs.columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert set(docs.columns) == names and {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    want = {r.doc_id for r in docs.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == want
    by_hand = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    pieces = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert pieces(out) == pieces(by_hand)
