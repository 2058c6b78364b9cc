import os

import pytest

import corpus_pipeline
from siltstone.llm import toxicity
from siltstone.llm.common import read_table, settle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, kept, SF), name)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score_toxicity(docs, read_table(spark, SF, "labels")).where("predicted = 1").collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad
        if name == "ngram_jaccard":
            texts = [r.text for r in out.collect()]
            assert len(texts) == len(set(texts)) and 0 < len(texts) < kept.count()
        if name == "mixing":
            assert set(out.select("doc_id").distinct().toPandas().doc_id) <= set(kept.toPandas().doc_id)
        if name == "sharding":
            assert out.count() == kept.count()
        kept = out
