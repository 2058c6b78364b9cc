"""As-of joins and sessions with hot keys against plain loops, and against Spark's own session windows over a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import timeline

T0 = dt.datetime(2024, 1, 1)


def moments(rng, n, keys):
    return [(None if rng.random() < 0.03 else rng.choice(keys), None if rng.random() < 0.03 else T0 + dt.timedelta(seconds=rng.randrange(4000)), i) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_last_value_before(spark, seed):
    rng = random.Random(seed)
    keys = ["hot"] * 18 + ["b", "c", "only left" if seed == 1 else "d"]
    left, right = moments(rng, 400, keys), [x for x in moments(rng, 90, keys) if x[0] != "only left"]
    right.append(("hot", T0, 1000))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        l = spark.createDataFrame(left, "k string, t timestamp, i int").repartition(5)
        r = spark.createDataFrame(right, "k string, t timestamp, o int").withColumn("v", F.col("o") * 2).repartition(3)
        got = {x.i: (x.last_t, x.last_o, x.last_v) for x in timeline.asof(l, r, "k", "t", "o").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(left)
    for k, t, i in left:
        found = max(((rt, o) for rk, rt, o in right if rk is not None and rk == k and rt is not None and t is not None and rt <= t), default=None)
        assert got[i] == ((*found, 2 * found[1]) if found else (None, None, None))


def plain_sessions(rows, gap):
    out = []
    for k in sorted({k for k, t, _ in rows if k is not None}):
        times, start = sorted(t for x, t, _ in rows if x == k and t is not None), 0
        for i in range(1, len(times) + 1):
            if i == len(times) or (times[i] - times[i - 1]).total_seconds() > gap:
                if i > start:
                    out.append((k, times[start], times[i - 1], i - start))
                start = i
    return sorted(out)


@pytest.mark.parametrize("gap", [1, 30, 100, 100_000])
def test_sessions_with_a_hot_key(spark, gap):
    rows = moments(random.Random(gap), 500, ["hot"] * 9 + ["b"])
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = timeline.sessions(spark.createDataFrame(rows, "k string, t timestamp, i int"), "k", "t", gap).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.k, r.start, r.end, r.n) for r in got) == plain_sessions(rows, gap)


def test_sessions_as_a_stream_gives_them(spark, tmp_path):
    rows = [x for x in moments(random.Random(3), 200, ["a", "b"]) if x[0] is not None and x[1] is not None]
    events = spark.createDataFrame(rows, "k string, t timestamp, i int")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withWatermark("t", "1 hour")
    found = stream.groupBy(F.session_window("t", "30 seconds").alias("w"), "k").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("n"))
    query = found.writeStream.format("memory").queryName("session_stream").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted((r.k, r.start, r.end, r.n) for r in timeline.sessions(events, "k", "t", 30).collect())
    assert sorted((r.k, r.start, r.end, r.n) for r in spark.table("session_stream").collect()) == want


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, t timestamp, i int")
    assert timeline.sessions(none, "k", "t", 5).collect() == []
    one = spark.createDataFrame([("a", T0, 1)], "k string, t timestamp, i int")
    assert timeline.asof(none, one, "k", "t", "i").collect() == []
    assert timeline.asof(one, none, "k", "t", "i").collect() == [("a", T0, 1, None, None)]
