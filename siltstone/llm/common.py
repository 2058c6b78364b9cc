"""What the operators share: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.batches import CHUNK_BYTES, MOST_KEYS, bitmap_of, bits_for, in_bitmap, modest_batches, text_chunks, with_columns
from siltstone.sources.tables import drop_settled, new_dir, settle, shared_dir

__all__ = ["CHUNK_BYTES", "MOST_KEYS", "bitmap_of", "bits_for", "drop_settled", "in_bitmap", "modest_batches", "new_dir", "read_table", "settle", "shared_dir", "text_chunks", "with_columns"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
