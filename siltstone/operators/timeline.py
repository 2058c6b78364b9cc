"""Joins and sessions along a time line (extensions; the reference has none): no key's rows have to meet in one task.

Rows are dealt by ranges of (key, time), so a hot key is spread over many ranges. Each range is worked out for itself, and
says in one row what it hands on to the next: the last value of its last key, or the last session's end. The driver carries
these on from range to range, one row each, and they are joined back to the ranges that begin within a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import settle


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """df written by ranges of order, with the range's number as `_part`."""
    return settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def asof(left: DataFrame, right: DataFrame, key: str, time: str, order: str, prefix: str = "last_") -> DataFrame:
    """left with, for each row, the last row of right of its key at its time or before: right's other columns, prefixed;
    nulls where there is none.

    left and right have key and time, of one type each; of right's rows of one key and time the one with the largest
    `order` is the last. Rows of left with a null key or time find nothing; repeated rows of left are rows of their own;
    rows of right with a null key or time are no one's. Columns of left keep their names, which may not begin with `_`.
    """
    values = [c for c in right.columns if c not in (key, time)]
    there = right.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    a = there.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(order).alias("_o"), F.struct(F.col(time).alias(time), *values).alias("_v"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"))
    b = left.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[order].dataType).alias("_o"), F.lit(None).cast(a.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_l"))
    rows = _ranged(a.unionByName(b), "_k", "_t", "_side", "_o")
    own = Window.partitionBy("_part", "_k").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(own))
    # What each range hands on: its last key, and the last row of right that this key has there.
    place = F.struct("_k", "_t", "_side", "_o")
    ends = rows.groupBy("_part").agg(F.min("_k").alias("first"), F.max_by("_k", place).alias("last"), F.max_by("_v", place).alias("v")).orderBy("_part").collect()
    carried, handed = [], None
    for r in ends:
        if handed and handed[0] == r.first and r.first is not None:
            carried.append((r._part, *handed))
        if r.v is not None or not handed or handed[0] != r.last:
            handed = (r.last, r.v) if r.v is not None else None
    schema = "_part int, _k " + rows.schema["_k"].dataType.simpleString() + ", _before " + rows.schema["_v"].dataType.simpleString()
    before = left.sparkSession.createDataFrame(carried, schema)
    out = rows.where("_side = 1").join(F.broadcast(before), ["_part", "_k"], "left").withColumn("_v", F.coalesce("_v", "_before"))
    return out.select("_l.*", *[F.col(f"_v.{c}").alias(f"{prefix}{c}") for c in (time, *values)])


def sessions(events: DataFrame, key: str, time: str, gap_s: int) -> DataFrame:
    """events (key, time: timestamp, ...) -> (key, start, end, n): stretches of a key's events, each gap_s seconds at
    most after the one before; start and end are the first and last event's times. Events without key or time are left out."""
    rows = _ranged(events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_k"), F.col(time).alias("_t")), "_k", "_t")
    own = Window.partitionBy("_part", "_k").orderBy("_t")
    apart = lambda a, b: F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp")) > gap_s * 1_000_000
    begins = F.coalesce(apart(F.lag("_t").over(own), F.col("_t")), F.lit(True))
    rows = rows.withColumn("_s", F.sum(begins.cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    local = settle(rows.groupBy("_part", "_k", "_s").agg(F.min("_t").alias("start"), F.max("_t").alias("end"), F.count(F.lit(1)).alias("n")), "sessions")
    # A range's first session goes on with the last of the range before, if that has its key and ended near enough; the
    # first of such a chain of ranges is the session's name.
    at = F.struct("_k", "start")
    edges = local.groupBy("_part").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max_by("end", at).alias("end"), F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    joined, name, before = [], None, None
    for r in edges:
        goes_on = before is not None and before.last._k == r.first._k and (r.first.start - before.end).total_seconds() <= gap_s
        if not goes_on:
            name = None
        else:
            name = name or (before._part, before.last.start)
            joined.append((r._part, r.first._k, r.first.start, *name))
        if r.n > 1:
            name = None
        before = r
    kind = local.schema["start"].dataType.simpleString()
    kinds = f"_part int, _k {local.schema['_k'].dataType.simpleString()}, start {kind}, _of int, _from {kind}"
    named = local.join(F.broadcast(events.sparkSession.createDataFrame(joined, kinds)), ["_part", "_k", "start"], "left")
    named = named.select("_k", F.coalesce("_of", "_part").alias("_of"), F.coalesce("_from", "start").alias("_from"), "start", "end", "n")
    return named.groupBy("_k", "_of", "_from").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).select(F.col("_k").alias(key), "start", "end", "n")
