"""Arrow batches of texts, results' schemas, and bitmaps of keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that an operator turns into arrays at a time.
CHUNK_BYTES = 2 << 20


@contextmanager
def modest_batches(spark: SparkSession) -> Iterator[None]:
    """While this holds, texts go to Python 1,000 rows at a time where the session has Spark's default of 10,000: a batch
    is held several times over (by the JVM, by Python, as arrays), and texts are long. The setting is put back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key, None)
    if own not in (None, "10000"):
        yield
        return
    spark.conf.set(key, "1000")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, own)


def with_columns(kept: Iterable[StructField], own: str, kept_first: bool = True) -> StructType:
    """A result's schema: columns that are kept, whatever their names and types, and those of its own."""
    own_fields = StructType.fromDDL(own).fields
    kept_fields = [StructField(f.name, f.dataType) for f in kept]
    return StructType([*kept_fields, *own_fields] if kept_first else [*own_fields, *kept_fields])


#: Keys up to which a bitmap of 16 MB has seven eighths of it free.
MOST_KEYS = 1 << 24


def bits_for(rows: int) -> int:
    """Bits of a bitmap's size that leave seven eighths of it free, within 128 KB and 16 MB; beyond, more keys share one."""
    return min(max((8 * rows).bit_length(), 20), 27)


def bitmap_of(df: DataFrame, key: str, bits: int = 24) -> bytes:
    """A bitmap of 2**bits bits with the top bits of a long key: 2 MB for 24, however many rows there are."""
    at = F.shiftrightunsigned(F.col(key), 64 - bits)
    rows = (
        df.select(F.bitmap_bucket_number(at + 1).alias("b"), F.bitmap_bit_position(at + 1).alias("p"))
        .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    width = 4096
    for r in rows:
        out[(r.b - 1) * width : r.b * width] = np.frombuffer(bytes(r.m), np.uint8)[: len(out) - (r.b - 1) * width]
    return out.tobytes()


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray, bits: int = 24) -> np.ndarray:
    at = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) > 0


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of rows in them) of parts of about `most` bytes; a longer text
    is a part of its own. A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
