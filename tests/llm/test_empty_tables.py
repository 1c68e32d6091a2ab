"""Every query and the pipeline give no rows, in the right columns, on empty tables."""

import corpus_pipeline
import pytest

from flowlens.llm.queries import LLM_ORACLES, LLM_QUERIES


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
    assert set(LLM_ORACLES) <= set(LLM_QUERIES)


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_query(spark, empty_sf, name):
    assert LLM_QUERIES[name](spark, empty_sf).collect() == []


def test_pipeline(spark, empty_sf):
    out = corpus_pipeline.run(spark, empty_sf)
    assert out.collect() == [] and out.columns[:2] == ["doc_id", "piece"]
