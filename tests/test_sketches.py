"""Merged states against states of the whole and against exact figures."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.operators import metrics, sketches


@pytest.fixture
def rows(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), rng.randrange(9), int(rng.paretovariate(0.4)) % 4000, rng.gauss(0, 1)) for _ in range(20_000)]
    data += [("a", 1, None, None), ("c", 2, 7, 1.5)]
    return data, spark.createDataFrame(data, "g string, day int, k long, v double").repartition(6)


def test_parts_merged_are_near_the_exact_figures(spark, rows):
    data, df = rows
    parts = sketches.states(df, ["g", "day"], "k", "v")
    weeks = sketches.merged(parts.withColumn("half", F.col("day") % 2), ["g", "half"])
    got = {r.g: r for r in sketches.estimates(sketches.merged(weeks, ["g"]), ["g"], [0.1, 0.5, 0.9], 3).collect()}
    whole = {r.g: r for r in sketches.estimates(sketches.states(df, ["g"], "k", "v"), ["g"], [0.5], 3).collect()}
    for g in "abc":
        own = [x for x in data if x[0] == g]
        exact = len({x[2] for x in own} - {None})
        assert got[g].rows == len(own) and abs(got[g].distinct - exact) <= max(1, 0.05 * exact) and abs(whole[g].distinct - exact) <= max(1, 0.05 * exact)
        values = sorted(x[3] for x in own if x[3] is not None)
        for p, q in zip((0.1, 0.5, 0.9), got[g].quantiles):
            assert abs(sum(v <= q for v in values) / len(values) - p) <= 0.03 or len(values) < 40
        counts = Counter(x[2] for x in own if x[2] is not None).most_common(3)
        assert [t["count"] for t in got[g].top if t["item"] is not None][: len(counts)] == [n for _, n in counts][: len([t for t in got[g].top if t["item"] is not None])]


def test_all_grains_in_one_pass(rows):
    data, df = rows
    got = metrics.grains(df, [["g"], ["g", "day"], []], ["g", "day"], F.count(F.lit(1)).alias("n"))
    assert got.columns == ["grain", "g", "day", "n"]
    assert {(r.grain, r.g, r.day): r.n for r in got.collect()} == {**{(1, g, None): n for g, n in Counter(x[0] for x in data).items()}, **{(0, *k): n for k, n in Counter((x[0], x[1]) for x in data).items()}, (3, None, None): len(data)}
