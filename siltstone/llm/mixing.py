"""Mixing sources to target weights by nested hash-threshold histograms; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import settle

#: Hex digits of the hash in one level of a histogram: 4096 buckets.
DIGITS = 3
LEVELS = 3
#: Sources' thresholds are broadcast up to so many; beyond, they are joined by salted keys.
BROADCAST_SOURCES = 50_000
SALTS = 32


def n_words(text):
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sized (source, size) -> (source, source_size, target). Sources by code point, null last, weigh `weights` in turn
    and share all sizes; a target stops at `most` times its source's size and the excess is shared by weight among the
    others until none is above: target = least(most * size, level * weight) for the one level at which they add up."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    w = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumns({"cap": F.col("source_size") * most, "total": F.sum("source_size").over(every), "all_w": F.sum("w").over(every)})
    per = per.withColumns({"left": F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)), "left_w": F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0))})
    # The first in this order that is not above its cap sets the level for itself and all after it.
    fits = F.col("left").cast("double") * F.col("w") / F.col("left_w") <= F.col("cap")
    per = per.withColumn("place", F.row_number().over(w))
    per = per.withColumn("at", F.min(F.when(fits, F.struct("place", "left", "left_w"))).over(every))
    level = F.col("at.left").cast("double") * F.col("w") / F.col("at.left_w")
    return per.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), level), F.col("cap").cast("double")).alias("target"))


def _by_source(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    """left join right by key: broadcast if right is small, or else with the hot sources' rows spread by a salt."""
    if few:
        return left.join(F.broadcast(right), "key")
    salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, source, text, ...) -> (doc_id, size, source_size, target, taken, copies, *keep), a row each.

    size counts the words between ASCII white space (null and empty text: 0). Each document is taken
    floor(target / source_size) times, and once more if its hash is under its source's threshold, so that the source's
    taken words come as near its target as its document at the threshold allows (half its size); none more than `most`
    times. Rows are ordered by md5 of doc_id (of the text where that is null), so reruns agree; repeated rows have one
    hash and share their fate. The threshold is found from sums by source and hash bucket; only the bucket in which the
    budget ends is refined. Null sources are a source of their own; a source without words gets target 0 and is taken
    once, at size 0. An empty table gives no rows. Columns not in keep are ignored, whatever their names.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    slim = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary")).alias("h"), *keep,
    ).withColumn("key", key)
    slim = settle(slim, "sizes")
    plan = targets(slim).withColumn("key", key).drop("source")
    plan = plan.withColumns({"full": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")})
    plan = settle(plan.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "targets")
    few = plan.count() <= BROADCAST_SOURCES

    # One level after another: the sums of the buckets within the bucket in which the budget ends.
    edge = plan.select("key", F.lit("").alias("at"), F.lit(0).cast("long").alias("under"), "rest")
    for level in range(LEVELS + 1):
        n = 32 if level == LEVELS else DIGITS * (level + 1)
        inside = slim.select("key", "h", "size") if level == 0 else _by_source(slim.select("key", "h", "size"), edge.select("key", "at"), few).where(F.col("h").startswith(F.col("at"))).drop("at")
        sums = inside.groupBy("key", F.substring("h", 1, n).alias("b")).agg(F.sum("size").alias("s"))
        sums = sums.join(F.broadcast(edge) if few else edge, "key")
        upto = F.col("under") + F.sum("s").over(Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("upto", upto)
        over = F.col("upto") * 2 - F.col("s") > F.col("rest") * 2 if level == LEVELS else F.col("upto") > F.col("rest")
        # None over in the last level: the threshold is after all of the bucket.
        place = F.struct("b", (F.col("upto") - F.col("s")).alias("under"))
        ends = sums.groupBy("key", "rest", "at").agg(F.min(F.when(over, place)).alias("e"), F.max(place).alias("z"))
        after = F.concat("at", F.lit("g")) if level == LEVELS else F.col("z.b")
        edge = settle(ends.select("key", F.coalesce("e.b", after).alias("at"), F.coalesce("e.under", "z.under").alias("under"), "rest"), "edges")
    plan = plan.join(edge.select("key", "at"), "key", "left")
    out = _by_source(slim, plan.select("key", "source_size", "target", "full", F.coalesce("at", F.lit("")).alias("at"), "rest"), few)
    copies = F.col("full") + F.when((F.col("rest") > 0) & (F.col("h") < F.col("at")), 1).otherwise(0)
    out = out.withColumn("copies", F.least(copies, F.lit(most)).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *keep)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs in the mix: each row as often as the mix takes it, with its own columns."""
    columns = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    taken = mix(docs.withColumn("whole_row", whole).select(*{"doc_id", "source", "text"}, "whole_row"), keep=("whole_row",))
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken.where("copies > 0").select("whole_row", times.alias("time")).select("whole_row.*")

