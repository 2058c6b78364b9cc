"""Resuming by state: repeated and late keys, a restart in mid-stream, a sink that was there before."""

import shutil

from pyspark.sql import functions as F

from siltstone.streaming import keyed


def test_keys_are_taken_once_over_restarts(spark, tmp_path):
    source, sink, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c1")
    kind = "id string, n int"
    schema = spark.createDataFrame([], kind).schema
    settings = dict(spark.conf.getAll)

    def arrive(*rows):
        spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").parquet(source)

    def run(at=checkpoint, **how):
        query = keyed.resume_keyed(spark, source, sink, at, schema, "id", "n", work=lambda df: df.withColumn("n", F.col("n") * 10), **how)
        query.awaitTermination(180)
        assert query.exception() is None
        return sorted((r.id, r.n) for r in keyed.read_taken(spark, sink, schema).collect())

    spark.createDataFrame([("old", 1)], kind).write.parquet(f"{sink}/before")
    arrive(("a", 2), ("a ", 1), ("b", 3), (None, 4), ("old", 5))
    want = [("a ", 10), ("b", 30), ("old", 1)]
    assert run(files=1) == want
    shutil.rmtree(f"{sink}/before")  # the sink is not read again: what it held is state
    arrive(("old", 6), ("b", 7), ("c", 8), ("c", 9))
    arrive(("c", 1), ("d", 11))
    got = run(files=1)
    assert [k for k, _ in got] == ["a ", "b", "c", "d"] and dict(got)["c"] in (80, 10)
    assert run() == got
    # a new checkpoint begins with the keys at the sink
    arrive(("e", 12))
    assert run(str(tmp_path / "c2")) == sorted([*got, ("old", 50), ("e", 120)])
    assert dict(spark.conf.getAll) == settings
