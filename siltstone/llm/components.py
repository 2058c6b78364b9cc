"""Connected components by alternating large and small stars; no group is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import drop_settled, settle


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> (node, root): root is the smallest node that links reach from node.

    Loops, repeated and reversed links count once; null ends are left out; nodes without a link to another are not
    in the result; no links give no rows. Each round works by joins and aggregates and is written to the shared
    folder, so that a lost executor costs at most a round.
    """
    edges = settle(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and a <> b").distinct(), "edges")
    before = _state(edges)
    while before[0]:  # until a round changes nothing
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = settle(small, "edges")
        now = _state(after)
        drop_settled(edges)
        edges = after
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(roots)
