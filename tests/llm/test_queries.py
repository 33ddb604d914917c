"""Every registered corpus query on the smallest tables; the pipeline stage by stage."""

import pytest

import corpus_pipeline
from riskgrid.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, name):
    ok, text = compare(spark, connect(sf), sf, name, QUERIES[name], ORACLES.get(name))
    assert ok, text


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf, documents):
    rows, docs = [documents.count()], documents
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        rows.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == documents.columns
        if name == "mixing sources to target weights":
            assert docs.subtract(before).count() == 0
    assert rows[0] > rows[1] >= rows[2] > rows[3] and rows[4] == rows[5]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_pipeline_of_nothing(spark, sf, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_pipeline_of_awkward_rows(spark, sf, awkward):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        assert docs.count() >= 0
