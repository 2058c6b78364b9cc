"""Published totals: quotas and thresholds worked out from them."""

from pyspark.sql import functions as F

from siltstone.functions import labels, text
from siltstone.operators import encode, metrics, sampling


def test_split_totals(spark):
    df = spark.range(3567 + 80 + 90).select(F.col("id"), F.when(F.col("id") < 3567, "a").when(F.col("id") < 3647, "b").otherwise("c").alias("g"))
    n = {r.split: r["count"] for r in sampling.by_group(df, "g", "id").groupBy("split").count().collect()}
    assert n == {"train": 2989, "validation": 373, "test": 375}


def test_two_stage_totals(spark):
    df = spark.range(3567).select("id", (F.col("id") % 4).cast("string").alias("y"))
    n = {r.split: r["count"] for r in sampling.two_stage(df, "y", "id").groupBy("split").count().collect()}
    assert n == {"train": 2853, "validation": 357, "test": 357}


def test_lowest_threshold_of_equals(spark):
    df = spark.createDataFrame([("true", 0.9), ("true", 0.7), ("not_true", 0.65), ("not_true", 0.1)], "gt string, prob double")
    best = metrics.best_threshold(metrics.sweep(df, [i / 100 for i in range(1, 100)])).first()
    assert (best.threshold, best.f1) == (0.66, 1.0)


def test_truncation_is_the_loop(spark):
    rows = [(a, b, k) for a in range(12) for b in range(12) for k in range(11)]
    df = spark.createDataFrame(rows, "a int, b int, k int")
    x, y = encode.truncated_lengths(F.col("a"), F.col("b"), F.col("k"))
    for r in df.select("a", "b", "k", x.alias("x"), y.alias("y")).collect():
        a, b = r.a, r.b
        while a + b > r.k:
            if a >= b:
                a -= 1
            else:
                b -= 1
        assert (r.x, r.y) == (a, b)


def test_spaces_and_words(spark):
    df = spark.createDataFrame([("  a b\tc ",), (None,), ("déjà vu x_1",)], "t string")
    got = [(r.s, r.n) for r in df.select(text.normalize_space("t").alias("s"), text.count_words("t").alias("n")).collect()]
    assert got == [("a b c", 3), ("", 0), ("déjà vu x_1", 3)]


def test_supports_may_be_inconsistent(spark):
    df = spark.createDataFrame([("hard_fraud_staged", ["Overly consistent", "physics mismatch"])], "l string, i array<string>")
    assert tuple(df.select(labels.relation_label("l", "i"), labels.inconsistency_type("l", "i")).first()) == ("supports", "dynamics_mismatch")


def test_strict_fragments():
    from siltstone.functions.jsonx import strict_fragments as strict

    assert strict('{"a": 1}') == (['{"a": 1}'], None) and strict("[]") == ([], None)
    assert strict('x {"a": 1} y [{"b": 2}, {"c": 3}] z') == (['{"a": 1}', '{"b": 2}', '{"c": 3}'], None)
    assert strict('{"annotations": [{"a": 1}]}')[0] == ['{"a": 1}'] and strict('{"annotations": 1}')[0] == ['{"annotations": 1}']
    assert strict(" ") == (None, "empty") and strict("words") == (None, "no objects")
    assert strict('{"a": 1} {bad')[1] == "no JSON value at 9" and strict("5")[1] == strict("[1]")[1] == strict('{"a": 1} [2]')[1] == "not all values are objects"
