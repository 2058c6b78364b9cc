"""Pairs of statements."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siltstone.operators.sampling import hash_order
from siltstone.sources.tables import drop_settled, numbered, settle


def within_claims(statements: DataFrame) -> DataFrame:
    """statements (claim_id, pos, role, text, ...) -> each insured driver's statement with each other of its claim:
    claim_id, pos_a, pos_b, role_a, role_b, text_a, text_b. Claims without either side give none."""
    side = lambda s: statements.select("claim_id", *[F.col(c).alias(f"{c}_{s}") for c in statements.columns if c != "claim_id"])
    a = side("a").where("role_a = 'insured_driver'")
    return a.join(side("b").where("role_b <> 'insured_driver'"), "claim_id")


def with_ids(pairs: DataFrame, *order: str, prefix: str = "PAIR-") -> DataFrame:
    """pair_id: numbered from 1 in order."""
    return numbered(pairs, *order, name="_n", start=1).withColumn("pair_id", _id(prefix)).drop("_n")


def _id(prefix: str):
    """Six digits, or as many as the number has."""
    number = F.col("_n").cast("string")
    return F.concat(F.lit(prefix), F.repeat(F.lit("0"), F.lit(6) - F.length(number)), number)


def neutral(statements: DataFrame, offsets: tuple[int, ...] = (1, 2, 3), seed: int = 42) -> DataFrame:
    """statements (id, claim_id, role, text) -> pairs of different claims: in hash order each statement with those
    `offsets` places on, once for each unordered pair of texts; h orders them for a draw. Statements without a text or
    a role are left out. Places are joined as numbers, so no cross join is made."""
    pool = statements.where((F.col("text") != "") & (F.col("role") != "")).withColumn("h", hash_order(seed, "id"))
    rows = numbered(pool, "h", "id")
    a = rows.select(F.col("_n").alias("n"), F.explode(F.array(*map(F.lit, offsets))).alias("step"), *[F.col(c).alias(f"{c}_a") for c in ("id", "claim_id", "role", "text")])
    b = rows.select(F.col("_n").alias("m"), *[F.col(c).alias(f"{c}_b") for c in ("id", "claim_id", "role", "text")])
    both = a.join(b, F.col("n") + F.col("step") == F.col("m")).where("claim_id_a <> claim_id_b")
    keep = [c for c in both.columns if c not in ("m",)]
    once = both.groupBy(F.least("text_a", "text_b").alias("x"), F.greatest("text_a", "text_b").alias("y")).agg(F.min_by(F.struct(*keep), F.struct("step", "n")).alias("r"))
    return once.select("r.*")


def neutral_sample(statements: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """statements (id, claim_id, role, text, ...) -> exactly n pairs of different claims, (pair_id, try, *_a, *_b), or
    RuntimeError if max(50 n, 1000) tries do not give them.

    The statements that have a text and a role, N of them, stand in a hash order that seed sets. Try t pairs the one at
    place t mod N with the one some places on, around the end: 1 + (k + t div N) mod (N - 1), k set by seed. A try fails if
    both are of one claim, or if an earlier try has the same two texts in either order. The first n that do not are the
    sample, so it does not depend on partitions. Rounds of N tries are drawn until there are enough; places are joined as
    numbers.
    """
    pool = statements.where((F.col("text") != "") & (F.col("role") != "")).withColumn("_h", hash_order(seed, "id"))
    rows = settle(numbered(pool, "_h", "id", "text").drop("_h"), "pool")
    size, most = rows.count(), max(50 * n, 1000)
    columns = [c for c in rows.columns if c != "_n"]
    shift = int(hashlib.md5(f"{seed}:shift".encode()).hexdigest()[:8], 16)
    upto, got, drawn = 0, 0, None
    while size > 1 and n > 0:
        upto = min(most, max(size, 2 * upto, -(-5 * n // 4 // size) * size))
        t = F.col("_r") * size + F.col("_n")
        a = rows.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((upto - 1) // size).cast("long")))).withColumn("try", t).where(F.col("try") < upto)
        a = a.withColumn("_m", (F.col("_n") + 1 + (F.col("_r") + shift) % F.lit(size - 1)) % F.lit(size))
        left = a.select("try", "_m", *[F.col(c).alias(f"{c}_a") for c in columns])
        right = rows.select(F.col("_n").alias("_m"), *[F.col(c).alias(f"{c}_b") for c in columns])
        both = left.join(right, "_m").drop("_m").where("claim_id_a <> claim_id_b")
        keep = F.struct(*[c for c in both.columns])
        once = both.groupBy(F.least("text_a", "text_b").alias("x"), F.greatest("text_a", "text_b").alias("y")).agg(F.min_by(keep, "try").alias("r")).select("r.*")
        drawn = settle(once, "drawn")
        got = drawn.count()
        if got >= n or upto >= most:
            break
        drop_settled(drawn)
    if got < n:
        raise RuntimeError(f"{got} of {n} neutral pairs in {upto} tries")
    if drawn is None:
        kinds = [StructField("try", LongType()), *(StructField(f"{f.name}_{k}", f.dataType) for k in "ab" for f in rows.schema if f.name != "_n")]
        drawn = statements.sparkSession.createDataFrame([], StructType(kinds))
    return numbered(drawn, "try", start=1).where(F.col("_n") <= n).withColumn("pair_id", _id("NEUTRAL-")).drop("_n")


def merge_teacher(source: DataFrame, annotations: DataFrame, whole_batch: bool = False) -> DataFrame:
    """source (pair_id, batch, label, inconsistency_type) left with annotations (pair_id, label, inconsistency_type, ok):
    pair_id, batch, weak_label, weak_type, label, inconsistency_type, outcome (accepted or rejected), changed_label and
    changed_type. whole_batch: one rejected row rejects its batch."""
    a = annotations.select("pair_id", F.col("label").alias("new_label"), F.col("inconsistency_type").alias("new_type"), F.col("ok"))
    j = source.join(a, "pair_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    if whole_batch:
        good = j.groupBy("batch").agg(F.min("ok").alias("ok"))
        j = j.drop("ok").join(good, "batch")
    y = F.when(F.col("ok"), F.col("new_label")).otherwise(F.col("label"))
    t = F.when(F.col("ok"), F.col("new_type")).otherwise(F.col("inconsistency_type"))
    return j.select("pair_id", "batch", F.col("label").alias("weak_label"), F.col("inconsistency_type").alias("weak_type"), y.alias("label"), t.alias("inconsistency_type"), F.when(F.col("ok"), "accepted").otherwise("rejected").alias("outcome"), (y != F.col("label")).alias("changed_label"), (t != F.col("inconsistency_type")).alias("changed_type"))
