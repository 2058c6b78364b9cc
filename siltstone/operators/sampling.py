"""Reproducible sampling and splitting: rows are drawn in the order of md5(seed:id), then id.

Draws within a class are by rank in that order. Ranks come from range partitions (hot classes do not meet in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import numbered, running, settle


def hash_order(seed: int, key: Column | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")).cast("binary"))


def ranked(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """df with h, rank (from 1 within the label, in hash order) and n (the label's rows)."""
    sizes = running(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), [label], {"_upto": "n"})
    sizes = settle(sizes.withColumn("_base", F.col("_upto") - F.col("n")).drop("_upto"), "sizes")
    rows = numbered(df.withColumn("h", hash_order(seed, key)), label, "h", key)
    same = rows[label].eqNullSafe(sizes[label])
    return rows.join(sizes, same).drop(sizes[label]).withColumn("rank", F.col("_n") - F.col("_base") + 1).drop("_n", "_base")


def balanced(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each label as the rarest has."""
    r = ranked(df, label, key, seed)
    least = df.groupBy(label).count().agg(F.min("count").alias("least"))
    return r.join(F.broadcast(least)).where("rank <= least").drop("least", "n", "rank", "h")


def two_way(df: DataFrame, label: str, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """split: validation or train; of each label max(1, round half even(n * ratio)), n - 1 at most; under two rows stop."""
    r = ranked(df, label, key, seed)
    k = F.least(F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(ratio)).cast("long")), F.col("n") - 1)
    k = F.when(F.col("n") < 2, F.raise_error(F.lit("a label has under two rows")).cast("long")).otherwise(k)
    return r.withColumn("split", F.when(F.col("rank") <= k, "validation").otherwise("train")).drop("n", "rank", "h")


def three_way(df: DataFrame, label: str, key: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """split: train, validation or test; train and validation rounded half even, the rest test; under three rows stop."""
    r = ranked(df, label, key, seed)
    a, b = F.bround(F.col("n") * F.lit(train)).cast("long"), F.bround(F.col("n") * F.lit(val)).cast("long")
    bad = (F.col("n") < 3) | (F.least(a, b, F.col("n") - a - b) <= 0)
    a = F.when(bad, F.raise_error(F.lit("a split would have no row of a label")).cast("long")).otherwise(a)
    return r.withColumn("split", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "validation").otherwise("test")).drop("n", "rank", "h")


def _largest_remainders(sizes: DataFrame, label: str, of: str, total: int, wanted: int, name: str) -> DataFrame:
    """sizes with `name`: wanted shared out in proportion to column `of`, which adds up to total; what rounding down leaves
    goes to the largest remainders, of equals to the first labels. No row is compared with all others in one task."""
    share = F.col(of) * F.lit(wanted).cast("long") / F.lit(total).cast("long")
    parts = settle(sizes.withColumn("_low", F.floor(share)).withColumn("_less", -F.round(share - F.floor(share), 9)), "parts")
    extra = wanted - parts.agg(F.sum("_low")).first()[0]
    placed = numbered(parts, "_less", label, name="_place", start=1)
    return placed.withColumn(name, F.col("_low") + F.when(F.col("_place") <= extra, 1).otherwise(0)).drop("_low", "_less", "_place")


def two_stage(df: DataFrame, label: str, key: str, held: float = 0.2, seed: int = 42) -> DataFrame:
    """split by label in proportion: ceil(N * held) rows held out by largest remainder, of which ceil(half) are test."""
    r = ranked(df, label, key, seed)
    sizes = settle(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.sum("n").alias("t")).select("t", F.ceil(F.round(F.col("t") * held, 6)).alias("w")).first()
    if total.t:
        sizes = _largest_remainders(sizes, label, "n", total.t, total.w, "q")
        sizes = _largest_remainders(sizes, label, "q", total.w, -(-total.w // 2), "q2")
    else:
        sizes = sizes.withColumns({"q": F.lit(0), "q2": F.lit(0)})
    sizes = settle(sizes.select(F.col(label).alias("_l"), "q", "q2"), "quotas")
    out = r.join(sizes, F.col(label).eqNullSafe(F.col("_l")))
    return out.withColumn("split", F.when(F.col("rank") <= F.col("q2"), "test").when(F.col("rank") <= F.col("q"), "validation").otherwise("train")).drop("n", "rank", "h", "_l", "q", "q2")


def by_group(df: DataFrame, group: str, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """split within each group: floor(n * train) train, floor(n * val) validation, the rest test."""
    r = ranked(df, group, key, seed)
    a, b = F.floor(F.col("n") * F.lit(train)), F.floor(F.col("n") * F.lit(val))
    return r.withColumn("split", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "validation").otherwise("test")).drop("n", "rank", "h")


def val_test(df: DataFrame, key: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """split: floor(N * ratio) rows validation, the rest test."""
    r = ranked(df.withColumn("_one", F.lit(1)), "_one", key, seed)
    return r.withColumn("split", F.when(F.col("rank") <= F.floor(F.col("n") * F.lit(ratio)), "validation").otherwise("test")).drop("n", "rank", "h", "_one")


def round_robin(df: DataFrame, bucket: str, total: int) -> DataFrame:
    """(bucket, quota): total spread over the buckets in order, one each in turn, as far as their rows go. A bucket gets
    its min(n, r) with r the last full turn, and one more for the first buckets of the turn in which total ends."""
    n = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    n = settle(n, "buckets")
    upto = lambda r: n.agg(F.coalesce(F.sum(F.least(F.col("n"), F.lit(r).cast("long"))), F.lit(0))).first()[0]
    low, high = 0, total + 1  # the last full turn is found by halving
    while high - low > 1:
        r = (low + high) // 2
        low, high = (r, high) if upto(r) <= total else (low, r)
    left = total - upto(low)
    out = n.withColumn("r", F.lit(low).cast("long"))
    more = F.when(F.col("n") > F.col("r"), 1).otherwise(0)
    out = running(out.withColumn("more", more), [bucket], {"turn": "more"})
    return out.select(bucket, (F.least("n", "r") + F.when((F.col("more") == 1) & (F.col("turn") <= left), 1).otherwise(0)).cast("long").alias("quota"))


def top_n(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def page(df: DataFrame, order: list, start: int, most: int) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(most)


def diverse(df: DataFrame, bucket: str, diversity: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """total rows, spread over the buckets by round_robin, no two of one diversity key. Buckets are taken in order, each
    in hash order; a row whose key was taken is passed over. What is short is filled up from all rows in another hash
    order; if that is too little, ValueError. key must tell rows apart; null buckets come first.

    Only what can be taken is gathered: `total` keys at most are taken, so of each bucket its first 2 * total keys, and as
    many of all rows, are enough. Both are bounds by the sample's own size and the number of buckets."""
    h = df.select(F.col(bucket).alias("_b"), F.col(diversity).alias("_d"), F.col(key).alias("_k"), hash_order(seed, key).alias("h"), hash_order(seed + 1, key).alias("h2"))

    def firsts(by: list[str], at: str) -> list:
        one = h.groupBy(*by, "_d").agg(F.min(F.struct(at, "_k")).alias("f")).select(*by, "_d", f"f.{at}", "f._k")
        if by:
            return one.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(at, "_k"))).where(F.col("_r") <= 2 * total).drop("_r").collect()
        return one.orderBy(at, "_k").limit(2 * total).collect()

    quota = {r[0]: r.quota for r in round_robin(df, bucket, total).collect()}
    seen, taken, room = set(), [], dict(quota)
    for r in sorted(firsts(["_b"], "h"), key=lambda r: (r._b is not None, r._b, r.h, r._k)):
        if room[r._b] > 0 and r._d not in seen:
            seen.add(r._d)
            taken.append(r._k)
            room[r._b] -= 1
    if len(taken) < total:
        for r in firsts([], "h2"):
            if len(taken) < total and r._d not in seen:
                seen.add(r._d)
                taken.append(r._k)
    if len(taken) < total:
        raise ValueError(f"{total} diverse rows wanted, {len(taken)} found")
    chosen = df.sparkSession.createDataFrame([(k,) for k in taken], f"`{key}` {df.schema[key].dataType.simpleString()}")
    return df.join(F.broadcast(chosen), key, "left_semi")
