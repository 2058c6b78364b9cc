"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from siltstone.llm.common import new_dir, read_table, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    columns = docs.columns
    named = docs.withColumn("whole_row", F.struct(*[F.col(f"`{c}`") for c in columns]))
    scored = toxicity.score_toxicity(named, read_table(spark, sf_dir, "labels"), keep=("whole_row",))
    return scored.where("predicted = 0").select("whole_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingle Jaccard of 0.8 or more: that with the smallest doc_id (null
    last), of several the one with the smallest hash of all its columns; of rows equal in every column one. Rows
    without words are no one's copies and stay. Different texts under one doc_id are different rows."""
    columns = docs.columns
    key = "row_key"
    while key in {c.lower() for c in columns}:
        key += "_"
    named = docs.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    found = jaccard_join.similar_classes(named, k=5, percent=80, keep=(key,)).where("cls is not null")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("first"))
    kept = named.join(first.select(F.col(f"first.{key}").alias(key)), key, "left_semi").dropDuplicates([key])
    wordless = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return kept.select(*[F.col(f"`{c}`") for c in columns]).unionByName(docs.where(wordless))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; those that are mostly passages go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the mix, repeated as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The committed shards' rows: where each document lies."""
    return sharding.placed(sharding.shard(docs, new_dir(spark, "corpus")))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: A classifier that is learnt is not SQL; tests hold near copies and decontamination against brute force, the mix against
#: its targets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
