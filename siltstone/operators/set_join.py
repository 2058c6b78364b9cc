"""Similarity join of sets by prefixes of the global order of their elements.

The global order of elements (words' runs) is (how common, 64-bit hash), common ones last. Two sets that are similar
enough share an element of their first n - ceil(t * n) + 1 in this order, so only those make candidates, and only where
the places of the element leave enough to share. For candidates the order is cut into fragments, the sets' parts in each
fragment are intersected apart, and the partial counts are summed by pair. Sets are made anew from the texts each time
they are needed; all of them are never written or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.wordarrays import BY_SPACE, mix, shingle_sets, span_hashes, spans
from siltstone.sources.batches import MOST_KEYS, bitmap_of, bits_for, in_bitmap, text_chunks, with_columns
from siltstone.sources.tables import drop_settled, settle

#: Elements whose counts are kept before they are sorted and counted.
FLUSH = 1 << 20
#: Classes of a list to a key, where lists are joined with themselves.
LIST_ROWS = 1024
#: Steps of commonness; a bitmap for each.
STEPS = 3
#: Parts of a set's sketch.
BUCKETS = 128
#: Bytes of text to a range of elements that are counted together; from WIDE bytes on they are told apart by longer keys.
RANGE_BYTES, WIDE = 8 << 20, 1 << 40
U = np.uint64


class Rule(NamedTuple):
    """A text's set: its distinct runs of k words, words being runs of the bytes with 1 in kind, A-Z as a-z. A column of
    lists is the sets themselves. grouped: a column with a group's number follows, and sets of two groups share nothing."""

    k: int
    kind: np.ndarray = BY_SPACE
    grouped: bool = False

    @property
    def columns(self) -> list[str]:
        return ["text", "group_key"] if self.grouped else ["text"]


def _sets(batch: pa.RecordBatch, at: int, rule: Rule) -> Iterator[tuple[int, list[np.ndarray]]]:
    texts, groups = batch.column(at), batch.column(at + 1).to_numpy().view(U) if rule.grouped else None

    def named(words: np.ndarray, first: np.ndarray, i: int) -> np.ndarray:
        return words if groups is None else mix(words ^ np.repeat(groups[i : i + len(first) - 1], np.diff(first)))

    if pa.types.is_list(texts.type):
        first = texts.offsets.to_numpy().astype(np.int64)
        flat, h = texts.flatten(), [np.zeros(0, U)]
        for _, _, data, off in text_chunks(flat):
            h.append(span_hashes(data, off[:-1], off[1:], lower=False))
        h = named(np.concatenate(h), first - first[0], 0)
        yield 0, [np.unique(h[a:b]) for a, b in zip(first[:-1] - first[0], first[1:] - first[0], strict=True)]
        return
    for i, _, data, off in text_chunks(texts):
        starts, ends, first = spans(data, off, rule.kind)
        yield i, shingle_sets(named(span_hashes(data, starts, ends), first, i), first, rule.k)


def _class(s: np.ndarray) -> int:
    """A set's 64-bit key; never 0."""
    with np.errstate(over="ignore"):
        x = mix(np.array([np.sum(mix(s ^ U(0xA0761D6478BD642F)), dtype=U) + U(len(s)) * U(0xE7037ED1A0B428DB)], U))
    return int(x.view(np.int64)[0]) or 1


def _counted(rule: Rule, range_bits: int, key: type):
    """Texts -> (r, keys, c): n-grams of different sets with their counts, dealt by the first range_bits of the hash; a
    key is the bits that follow. Sorted and counted after some megabytes each time."""

    def dealt(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.sort(np.concatenate(held))
        at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        c = np.minimum(np.diff(np.append(at, len(x))), 255).astype(np.uint8)
        x = x[at]
        r = np.arange(1 << range_bits)
        edges = np.append(np.searchsorted(x, r.astype(U) << U(64 - range_bits)), len(x))
        keys = ((x << U(range_bits)) >> U(64 - 8 * np.dtype(key).itemsize)).astype(key)
        for i in range(0, len(r), 64):
            part = [j for j in r[i : i + 64].tolist() if edges[j + 1] > edges[j]]
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array([keys[edges[j] : edges[j + 1]].tobytes() for j in part], pa.binary()), pa.array([c[edges[j] : edges[j + 1]].tobytes() for j in part], pa.binary())], ["r", "keys", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # copies count once
        size = 0
        for batch in batches:
            for _, sets in _sets(batch, 0, rule):
                for s in sets:
                    if len(s) and (name := _class(s)) not in held:
                        held[name] = s
                        size += len(s)
                if size > FLUSH:
                    yield from dealt([*held.values()])
                    held, size = {}, 0
        if size:
            yield from dealt([*held.values()])

    return run


def _often(least: int, range_bits: int, key: type):
    """The n-grams of a range (their first bits as a long) in `least` sets or more."""

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            keys += [np.frombuffer(x, key) for x in batch.column("keys").to_pylist()]
            counts += [np.frombuffer(x, np.uint8) for x in batch.column("c").to_pylist()]
        x, c = np.concatenate(keys), np.concatenate(counts)
        keys.clear()
        order = np.argsort(x)
        x = x[order]
        at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        total = np.add.reduceat(c[order].astype(np.int64), at)
        many = total >= least
        h = (x[at[many]].astype(U) << U(64 - 8 * np.dtype(key).itemsize) >> U(range_bits)) | (U(group[0].as_py()) << U(64 - range_bits))
        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(total[many])], ["h", "c"])

    return run


def _keys(s: np.ndarray, bitmaps: list[np.ndarray]) -> np.ndarray:
    """The n-grams' places in the global order, as sorted longs: 62 bits of hash after two bits of how common it is."""
    step = np.zeros(len(s), U)
    for b in bitmaps:  # each holds what the next one holds
        step += in_bitmap(b, s, (8 * len(b)).bit_length() - 1)
    key = ((s >> U(2)) | (step << U(62))) ^ U(1 << 63)
    return np.concatenate([key[step == U(i)] for i in range(STEPS + 1)]).view(np.int64)


def _bitmaps(common: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8) for x in common]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)), pa.array(flat))


def _sketch(s: np.ndarray) -> bytes:
    """How many elements of a set are in each of BUCKETS parts of their hashes; 255 is that or more."""
    return np.minimum(np.bincount((s >> U(20)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _may_share(percent: int):
    """Of pairs (a, b, na, nb, ska, skb) those (a, b) whose sketches leave enough to share: two sets have no more in common
    than the lesser of their counts in each part. Where a count is full nothing is known, and the pair stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS) for k in ("ska", "skb"))
            least, both = np.minimum(x, y), batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            good = (least == 255).any(1) | ((100 + percent) * least.sum(1, dtype=np.int64) >= percent * both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def able(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that can be similar enough by the classes' sketches (cls, n, sketch); none that is goes."""
    side = lambda k: sketches.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"sk{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ska", "skb").mapInArrow(_may_share(percent), "a long, b long")


def _prefixes(rule: Rule, percent: int, common: list[bytes], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = _bitmaps(common)
        for batch in batches:
            for i, sets in _sets(batch, 1, rule):
                n = [len(s) for s in sets]
                keys = [_class(s) if len(s) else None for s in sets]
                parts = [_keys(s, bitmaps)[: m - (percent * m + 99) // 100 + 1] if m else np.zeros(0, np.int64) for s, m in zip(sets, n, strict=True)]
                rest = [c.slice(i, len(sets)) for c in batch.columns[1 + len(rule.columns) :]]
                own = [pa.array([_sketch(s) for s in sets], pa.binary())] if "sketch" in names else []
                yield pa.record_batch([batch.column(0).slice(i, len(sets)), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), _lists(parts), *own, *rest], names)

    return run


def _shared_only(lists: bytes, bits: int):
    """Of prefixes the n-grams that the bitmap holds, and their places in the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(lists, np.uint8)
        for batch in batches:
            prefix = batch.column(2)
            flat, edges = prefix.flatten().to_numpy(), prefix.offsets.to_numpy()
            row = np.repeat(np.arange(len(prefix)), np.diff(edges))
            place = np.arange(len(flat)) - (edges[:-1] - edges[0])[row]
            good = in_bitmap(bitmap, flat.view(U) << U(2), bits)
            at = pa.array(row[good])
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(flat[good]), pa.array(place[good].astype(np.int64))], ["cls", "n", "h", "pos"])

    return run


def _segments(rule: Rule, wanted: bytes, bits: int, common: list[bytes], fragments: int):
    """The wanted classes' sets, cut where the global order's fragments meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, done = np.frombuffer(wanted, np.uint8), set()
        bitmaps = _bitmaps(common)
        edges = np.array([(i << 62) // (fragments - STEPS) - (1 << 63) for i in range(1, fragments - STEPS)] + [(i << 62) - (1 << 63) for i in range(1, STEPS + 1)], np.int64)
        for batch in batches:
            for _, sets in _sets(batch, 0, rule):
                keys = np.array([_class(s) if len(s) else 0 for s in sets], np.int64)
                for j in np.flatnonzero((keys != 0) & in_bitmap(bitmap, keys.view(U), bits)).tolist():
                    key = int(keys[j])
                    if key in done:
                        continue
                    if len(done) > 1_000_000:
                        done.clear()
                    done.add(key)
                    s = _keys(sets[j], bitmaps)
                    at = np.concatenate(([0], np.searchsorted(s, edges), [len(s)])).astype(np.int32)
                    yield pa.record_batch([pa.array([key] * fragments), pa.array([len(s)] * fragments, pa.int64()), pa.array(range(fragments), pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(s))], ["cls", "n", "frag", "seg"])

    return run


def _batched(run, rows: int = 512, most: int = 4 << 20):
    """Joins small record batches into larger ones, up to so many of them or bytes."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if len(held) >= rows or size > most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def _common_ngrams(docs: DataFrame, rule: Rule, least: int) -> list[bytes]:
    """Bitmaps with the n-grams in `least` sets or more, in 8 times and in 64 times as many. All n-grams are counted, by
    ranges of their hash. Where there are too many for a bitmap the least count doubles until they fill an eighth of it;
    what is taken for rarer or more common than it is only changes its place in the order, and so no result."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    range_bits, key = min(max(int(size // RANGE_BYTES).bit_length(), 4), 16), np.uint32 if size < WIDE else np.uint64
    counted = docs.select(*rule.columns).mapInArrow(_counted(rule, range_bits, key), "r int, keys binary, c binary")
    counts = settle(counted.groupBy("r").applyInArrow(_often(least, range_bits, key), "h long, c long"), "common")
    steps = {r.s: r.n for r in counts.groupBy(F.floor(F.log2(F.col("c") / least)).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    step = 0
    while (n := sum(m for s, m in steps.items() if s >= step)) > MOST_KEYS:
        step += 1
    out = [bitmap_of(counts.where(F.col("c") >= least << step << 3 * i), "h", bits_for(n)) for i in range(STEPS)]
    drop_settled(counts)
    return out


def may_begin(nx: str, ny: str, px: str, py: str, percent: int):
    """Sets of nx and ny n-grams whose first common one is at places px and py can be similar enough. Each similar pair
    meets in the list of its first common n-gram, where this holds, so no pair is lost by asking it in every list."""
    left = F.least(F.col(nx) - F.col(px), F.col(ny) - F.col(py))
    return (F.lit(100 + percent) * left >= F.lit(percent) * (F.col(nx) + F.col(ny))) & (F.lit(100) * F.least(nx, ny) >= F.lit(percent) * F.greatest(nx, ny))


def candidates(live: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that meet in a list of live (h, c, cls, n, pos) where it can be their first."""
    left = on_a_salt(live.select("h", "c", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa")), "a")
    right = on_every_salt(live.select("h", "c", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb")))
    return left.join(right, ["h", "salt"]).where("a < b").where(may_begin("na", "nb", "pa", "pb", percent)).select("a", "b").distinct()


def on_a_salt(rows: DataFrame, by: str) -> DataFrame:
    """rows of lists (h) of c rows, with one of the salts that a list of c has."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.floor(F.col("c") / LIST_ROWS) + 1).cast("int")).drop("c")


def on_every_salt(rows: DataFrame) -> DataFrame:
    """rows of lists (h) of c rows, with each of the salts that a list of c has."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.floor(F.col("c") / LIST_ROWS).cast("int")))).drop("c")


def fetched(classes: DataFrame, docs: DataFrame, rule: Rule, common: list[bytes], fragments: int) -> DataFrame:
    """(cls, n, frag, seg) of the classes, each fragment once."""
    ends = settle(classes.distinct(), "ends")
    bits = bits_for(ends.count())
    found = docs.select(*rule.columns).mapInArrow(_batched(_segments(rule, bitmap_of(ends, "cls", bits), bits, common, fragments)), "cls long, n long, frag int, seg array<long>")
    out = settle(found.join(ends, "cls", "left_semi").dropDuplicates(["cls", "frag"]), "segments")
    drop_settled(ends)
    return out


def overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, o) of the pairs (a, b) whose sets are similar enough: partial overlaps by fragment, summed by pair."""
    left = segments.select(F.col("cls").alias("b"), F.col("n").alias("nb"), "frag", F.col("seg").alias("sb"))
    right = segments.select(F.col("cls").alias("a"), F.col("n").alias("na"), "frag", F.col("seg").alias("sa"))
    partial = pairs.join(left, "b").join(right, ["a", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("o"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(F.lit(100) * F.col("o") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("o")))


def prepared(docs: DataFrame, rule: Rule, percent: int, common_from: int, keep: tuple[str, ...] = (), sketch: bool = False) -> tuple[DataFrame, list[bytes], DataFrame, DataFrame]:
    """With sketch, the rows have it too. (docs, common n-grams, rows with their class, classes in the lists (h, c classes) of their prefixes' n-grams)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *rule.columns, *[F.col(f"`{c}`") for c in keep])
    common = _common_ngrams(docs, rule, common_from)
    schema = with_columns([docs.schema[c] for c in keep], "doc_id long, n long, cls long, prefix array<long>" + ", sketch binary" * sketch, kept_first=False)
    slim = settle(docs.mapInArrow(_prefixes(rule, percent, common, ["doc_id", "n", "cls", "prefix", *["sketch"] * sketch, *keep]), schema), "prefixes")
    reps = settle(slim.where("cls is not null").select("cls", "n", "prefix").dropDuplicates(["cls"]), "reps")
    lists = settle(reps.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "lists")
    bits = bits_for(lists.count())
    shared = bitmap_of(lists.select(F.shiftleft("h", 2).alias("h")), "h", bits)
    live = settle(reps.mapInArrow(_shared_only(shared, bits), "cls long, n long, h long, pos long").join(lists, "h"), "live")
    drop_settled(lists, reps)
    return docs, common, slim, live
