"""Images of cases: read as binary files, tagged by a model that the caller gives, their damages added to the cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.scoring import score

TAGS = "damage_types array<string>, raw array<struct<tag:string,score:double>>"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image: where it lies, name: its file's name, length, content); Spark leaves out files of no bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("image"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def stored_path(case_id: str, name: str):
    """Where an upload is kept, from its case and its file's name."""
    return F.concat(F.lit("uploads/case_"), F.col(case_id).cast("string"), F.lit("_"), F.col(name))


def tag_batches(images: DataFrame, load: Callable[[], Callable[[list[bytes]], list[list[tuple[str, float]]]]], threshold: float, rows: int = 16, tries: int = 1) -> DataFrame:
    """images (image, case_id, name, content) -> (image, file_path, damage_types, raw, reason). load builds a tagger, once
    in a worker, that gives the (tag, score) pairs of each of a list of images, `rows` of them and 8 MB at most;
    damage_types are the tags of threshold or more, each once, in the tagger's order. No content gives no tags. reason
    says why an image could not be tagged; null otherwise."""

    def build():
        tagger = load()

        def call(batch: list[dict]) -> list[dict]:
            there = [r["content"] for r in batch if r["content"]]
            found = iter(tagger(there) if there else [])
            out = []
            for r in batch:
                raw = next(found) if r["content"] else []
                out.append({"damage_types": list(dict.fromkeys(t for t, s in raw if s >= threshold)), "raw": [{"tag": t, "score": float(s)} for t, s in raw]})
            return out

        return call

    src = images.select("image", stored_path("case_id", "name").alias("file_path"), "content")
    return score(src, ["image", "file_path"], build, TAGS, rows=rows, tries=tries).drop("tries")


def tag_images(images: DataFrame, tagger: Callable[[bytes], list[tuple[str, float]]], threshold: float) -> DataFrame:
    """tag_batches with a tagger of one image; an image that it fails on stops the query."""
    tagged = tag_batches(images, lambda: lambda contents: [tagger(c) for c in contents], threshold)
    failed = F.raise_error(F.concat(F.lit("image not tagged: "), F.col("reason")))
    return tagged.withColumn("raw", F.when(F.col("reason").isNotNull(), failed.cast("void").cast(tagged.schema["raw"].dataType)).otherwise(F.col("raw"))).drop("reason")


def merge_damages(cases: DataFrame, found: DataFrame) -> DataFrame:
    """cases (case_id, detected_damages, ...) with the damages of found (case_id, position, damage_types) added: those
    known come first, new ones follow in the order of position, each once. Only a case's distinct damages are gathered."""
    known = cases.select("case_id", F.lit(0).alias("after"), F.lit(0).cast("long").alias("position"), F.posexplode("detected_damages").alias("place", "damage"))
    new = found.select("case_id", F.lit(1).alias("after"), F.col("position").cast("long").alias("position"), F.posexplode("damage_types").alias("place", "damage"))
    firsts = known.unionByName(new).groupBy("case_id", "damage").agg(F.min(F.struct("after", "position", "place")).alias("at"))
    merged = firsts.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "damage"))), lambda x: x["damage"]).alias("_merged"))
    rest = [F.col(f"`{c}`") for c in cases.columns if c != "detected_damages"]
    return cases.join(merged, "case_id", "left").select(*rest, F.coalesce("_merged", "detected_damages").alias("detected_damages"))
