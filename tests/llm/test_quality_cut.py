"""The quality cut is a quantile of all texts' scores, not of the labelled ones'."""

import random

from siltstone.llm import quality_classifier


def test_cut_covers_all_texts(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(20, 60))) + "."
    labelled = [(i, good() if i % 2 else good().upper().replace(" ", "!! ")) for i in range(200)]
    rest = [(1000 + i, good()) for i in range(1800)]
    docs = spark.createDataFrame(labelled + rest, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality_classifier.score_quality(docs, labels).collect()
    assert len(got) == 2000 and 0.4 < sum(r.predicted for r in got) / 2000 < 0.6
