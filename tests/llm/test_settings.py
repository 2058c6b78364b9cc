"""Operators leave the session's settings as they are."""

import pytest

from siltstone.llm import queries
from siltstone.llm.common import modest_batches


@pytest.mark.parametrize("name", ["op4_shard", "op5_ngram_jaccard", "op9_quality_rank", "op10_toxicity", "op11_importance_resampling"])
def test_settings_after_a_query(spark, name):
    before = dict(spark.conf.getAll)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert dict(spark.conf.getAll) == before


def test_batches_are_put_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for own in (None, "10000", "77"):
        if own:
            spark.conf.set(key, own)
        with pytest.raises(ZeroDivisionError), modest_batches(spark):
            assert spark.conf.get(key) == ("77" if own == "77" else "1000")
            raise ZeroDivisionError
        assert spark.conf.get(key, None) == own
    spark.conf.unset(key)
