"""One JSON list of objects in a file of any size, read in parallel.

Spark's text source splits a file into blocks of bytes and gives each task the records that begin in its block; here a
record ends with a closing brace. Whether a block begins within a string, and how deep, is not known where it is read. So a
first pass says, for either case, what a block does: the case at its end, the change of depth, and how many records end at
which relative depth outside strings. The driver joins these blocks' summaries in order, which gives every block its begin
and the number of the first element that ends in it. A second pass cuts the elements; what lies across a block's border is
put together by element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of JSON.
SPACE = b" \t\n\r"
_OPEN, _CLOSE = np.zeros(256, np.int64), np.zeros(256, np.int64)
_OPEN[[123, 91]] = 1
_CLOSE[[125, 93]] = 1


def _scan(records: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At the end of each record, its brace included: (quotes so far that open or close a string, depth so far where the
    block begins outside a string, where it begins inside one)."""
    data = np.frombuffer(b"}".join(records) + b"}", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in records]) - 1
    slash = data == 92
    edge = np.flatnonzero(np.diff(np.concatenate(([False], slash, [False])).astype(np.int8)))
    odd = edge[1::2][(edge[1::2] - edge[::2]) % 2 == 1]  # what follows an odd number of backslashes is no quote
    quote = data == 34
    quote[odd[odd < len(data)]] = False
    quotes = np.cumsum(quote)
    step = (_OPEN - _CLOSE)[data]
    inside = quotes & 1
    return quotes[ends], np.cumsum(np.where(inside == 0, step, 0))[ends], np.cumsum(np.where(inside == 1, step, 0))[ends]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """(file, block, records) of consecutive rows of one block."""
    for batch in batches:
        files, blocks = batch.column(1).to_pylist(), batch.column(2).to_numpy()
        edges = [0, *(i for i in range(1, len(files)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]), len(files)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield files[a], int(blocks[a]), [x or b"" for x in batch.column(0).slice(a, b - a).to_pylist()]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks -> (file, block, inside, ends inside, change of depth, depths, counts): for a block that begins outside
    or inside a string."""
    held: dict[tuple[str, int, int], tuple[int, int, dict[int, int]]] = {}
    for file, block, records in _blocks(batches):
        quotes, *depths = _scan(records)
        for begin in (0, 1):
            key = (file, block, begin)
            inside, depth, ends = held.get(key, (begin, 0, {}))
            now = depths[inside] + depth
            outside = now[(quotes + inside) % 2 == 0]
            for d, n in zip(*np.unique(outside, return_counts=True), strict=True):
                ends[int(d)] = ends.get(int(d), 0) + int(n)
            held[key] = ((int(quotes[-1]) + inside) % 2, int(now[-1]), ends)
    for (file, block, begin), (inside, depth, ends) in held.items():
        yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "begin": begin, "inside": inside, "depth": depth, "ends": list(ends.items())}], _SUMMARY)


_SUMMARY = pa.schema([("file", pa.string()), ("block", pa.int64()), ("begin", pa.int32()), ("inside", pa.int32()), ("depth", pa.int64()), ("ends", pa.map_(pa.int64(), pa.int64()))])
_SUMMARY_KIND = "file string, block long, begin int, inside int, depth long, ends map<long, long>"
_PIECES_KIND = "file string, n long, block long, whole boolean, text binary"


def _pieces(begins: dict[tuple[str, int], tuple[int, int, int]]):
    """Rows of blocks -> (file, n, block, whole, text): elements, or the parts that a block has of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[str, int], list] = {}
        for file, block, records in _blocks(batches):
            # inside, depth, number of the element, parts that are open, whether they begin in this block
            state = states.setdefault((file, block), [*begins[file, block], [], block == 0])
            quotes, *depths = _scan(records)
            inside, before, n, held, own = state
            depth = depths[inside] + before
            ends = np.flatnonzero(((quotes + inside) % 2 == 0) & (depth == 1))
            numbers, whole, texts, at = [], [], [], 0
            for e in ends.tolist():
                texts.append(b"}".join([*held, *records[at : e + 1]]) + b"}")
                numbers.append(n)
                whole.append(own)
                held, own, at, n = [], True, e + 1, n + 1
            held += records[at:]
            states[file, block] = [int(quotes[-1] + inside) % 2, int(depth[-1]), n, held, own]
            if texts:
                yield pa.record_batch([pa.array([file] * len(texts)), pa.array(numbers, pa.int64()), pa.array([block] * len(texts), pa.int64()), pa.array(whole), pa.array(texts, pa.binary())], ["file", "n", "block", "whole", "text"])
        for (file, block), (_, _, n, held, _) in states.items():
            if held:
                yield pa.record_batch([pa.array([file]), pa.array([n], pa.int64()), pa.array([block], pa.int64()), pa.array([False]), pa.array([b"}".join(held) + b"}"], pa.binary())], ["file", "n", "block", "whole", "text"])

    return run


def _objects(counts: dict[str, int]):
    """(file, n, text) -> (file, n, text): elements without what stands before them; the last is what ends the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, numbers, out, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []
            for i, raw in enumerate(batch.column(2).to_pylist()):
                file, n, text = files[i], numbers[i], raw.strip(SPACE)
                last = n == counts[file]
                if last:  # the last record is given a brace that the file does not have
                    text = text[:-1].rstrip(SPACE)
                first, rest = text[:1], text[1:].strip(SPACE)
                if first != (b"[" if n == 0 else b"]" if last else b",") or last and n > 0 and rest or last and n == 0 and rest != b"]" or not last and rest[:1] != b"{":
                    raise ValueError(f"element {n + 1} of {file} is no object, or the file is no JSON list")
                if not last:
                    out.append(rest)
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, pa.binary())], ["file", "n", "text"])

    return run


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, text) of the elements, numbered from 0 in their file, of files that are each one JSON list of objects.

    Raises ValueError where a file is no list that is closed; an element that is no object stops the query that meets it,
    with its number from 1. Files without a byte have no elements. path: a file, or a folder or pattern of them. The driver
    holds a few numbers for each block. An element is put together in one task, so it has to fit there.
    """
    rows = spark.read.option("lineSep", "}").text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    found = {}
    for r in rows.mapInArrow(_summaries, _SUMMARY_KIND).collect():
        found.setdefault(r.file, {}).setdefault(r.block, {})[r.begin] = r
    begins: dict[tuple[str, int], tuple[int, int, int]] = {}
    counts: dict[str, int] = {}
    for file, blocks in found.items():
        inside = depth = n = 0
        for block in sorted(blocks):
            begins[file, block] = (inside, depth, n)
            r = blocks[block][inside]
            n += r.ends.get(1 - depth, 0)
            inside, depth = r.inside, depth + r.depth
        counts[file] = n
        if inside or depth != -1:  # the brace that the last record is given closes once more than the list
            raise ValueError(f"{file} is no JSON list, or is not closed")
    pieces = rows.mapInArrow(_pieces(begins), _PIECES_KIND)
    parts = pieces.where("not whole").groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["text"]))
    every = pieces.where("whole").select("file", "n", "text").unionByName(parts.select("file", "n", joined.alias("text")))
    return every.mapInArrow(_objects(counts), "file string, n long, text binary").select("file", "n", F.col("text").cast("string").alias("text"))


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The objects of a file that is one JSON list of them, by schema; anything else stops the query. The file is read in
    as many tasks as it has blocks."""
    row = F.from_json("text", schema, {"mode": "FAILFAST"}).alias("row")
    return elements(spark, path).select(row).select("row.*")
