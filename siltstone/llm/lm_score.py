"""Language-model scores of whole texts by context mixing (context_mixing), beside the add-one unigram of their tokens.

A text is a row of tokens: its words (between ASCII white space, A-Z lower-cased) and one end. Training tokens are counted
by ranges of their hash; the frequent ones (at most TOP, each seen twice at least) are broadcast as the code, and texts are
written once more as their numbers, other words as bytes. Over those the model's counts by slot, then by cell, are added up
and the texts are scored. The unigram needs the other tokens' counts too; they are met by hash range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import context_mixing as cm
from siltstone.llm.common import modest_batches, settle, text_chunks
from siltstone.llm.quality_classifier import fold
from siltstone.llm.wordarrays import BY_SPACE, span_hashes, spans

U = np.uint64
#: Blocks of the model's counts, and first sums of each.
BLOCKS, FAN = 64, 16
#: Tokens that are broadcast with their counts: 16 bytes each, and as much for their code.
TOP = 1 << 19
#: Bytes of text to a range of tokens that are counted together.
RANGE_BYTES = 32 << 20
#: Training tokens to a task that counts for the tables.
TASK_TOKENS = 6_000_000
#: Words outside the code are told apart so far where they are contexts.
OTHERS = 1 << 20


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans' bytes one after another, A-Z lower-cased, and their offsets."""
    lengths = ends - starts
    off = np.concatenate(([0], np.cumsum(lengths)))
    raw = data[np.repeat(starts - off[:-1], lengths) + np.arange(off[-1])]
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8), off


def _added(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, c = h[order], c[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(c, at) if len(at) else c


def _counts(range_bits: int):
    """Texts -> (r, hs, cs): words' hashes and counts by range, after some megabytes each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, c = _added(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            held.clear()
            edges = np.append(np.searchsorted(h, np.arange(1 << range_bits).astype(U) << U(64 - range_bits)), len(h))
            for i in range(0, 1 << range_bits, 64):
                part = [j for j in range(i, min(i + 64, 1 << range_bits)) if edges[j + 1] > edges[j]]
                yield pa.record_batch([pa.array(part, pa.int32()), pa.array([h[edges[j] : edges[j + 1]].tobytes() for j in part], pa.binary()), pa.array([c[edges[j] : edges[j + 1]].tobytes() for j in part], pa.binary())], ["r", "hs", "cs"])

        for batch in batches:
            for _, _, data, off in text_chunks(batch.column(0), 8 << 20):
                s, e, _ = spans(data, off, BY_SPACE)
                h = span_hashes(data, s, e)
                held.append(_added(h, np.ones(len(h), np.int64)))
                size += len(data)
                if size > 32 << 20:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _range_counts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for batch in batches:
        held[0].extend(np.frombuffer(x, U) for x in batch.column("hs").to_pylist())
        held[1].extend(np.frombuffer(x, np.int64) for x in batch.column("cs").to_pylist())
    h, c = _added(*map(np.concatenate, held))
    for i in range(0, len(h), 1 << 16):
        yield pa.record_batch([pa.array(h[i : i + (1 << 16)].view(np.int64)), pa.array(c[i : i + (1 << 16)])], ["h", "c"])


class Top:
    """The frequent tokens by hash: their places in order of the hash, and counts."""

    BITS = 20

    def __init__(self, h: np.ndarray, c: np.ndarray):
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        self.starts = np.searchsorted(self.h >> U(64 - self.BITS), np.arange((1 << self.BITS) + 1, dtype=U)).astype(np.int32)
        self.longest = int(np.diff(self.starts).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places, or -1."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.h):
            return out
        bucket = (h >> U(64 - self.BITS)).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        left = np.flatnonzero(at < end)
        for _ in range(self.longest):
            hit = self.h[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
            if not len(left):
                break
        return out


_ENCODED = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("block", pa.int64()), ("at", pa.int32()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()),
    ("ids", pa.list_(pa.int32())), ("words", pa.binary()), ("lens", pa.list_(pa.int32())), ("frag", pa.int32()), ("hs", pa.binary()), ("ats", pa.binary()), ("ns", pa.binary()),
])
_ENCODED_KIND = "doc_id long, held_out boolean, block long, at int, n_tokens long, n_bytes long, n_known long, base double, ids array<int>, words binary, lens array<int>, frag int, hs binary, ats binary, ns binary"


def _encoded(share, ends: int, total: int, distinct: int, fragment_bits: int):
    """(doc_id, held_out, text) -> a row for each text: tokens' numbers, other words' bytes, sums over its frequent tokens;
    and rows with the other tokens' hashes and texts by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        top: Top = share.value
        k = len(top.h)
        known_at, base_of = np.append(top.c > 0, False), np.append(np.log10((top.c + 1.0) / (total + distinct + 1.0)), 0.0)
        end_base = np.log10((ends + 1.0) / (total + distinct + 1.0))
        block, rows, tail = TaskContext.get().partitionId() << 24, 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            h, at = np.concatenate([x[0] for x in tail]), np.concatenate([x[1] for x in tail])
            tail.clear()
            order = np.lexsort((at, h))
            h, at = h[order], at[order]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (at[1:] != at[:-1])))) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(h))).astype(np.int32)
            h, at = h[first], at[first].astype(np.int32)
            frag = (h >> U(64 - fragment_bits)).astype(np.int64)
            edges = [0, *(np.flatnonzero(np.diff(frag)) + 1).tolist(), len(frag)]
            out = [{"block": block, "frag": int(frag[a]), "hs": h[a:b].tobytes(), "ats": at[a:b].tobytes(), "ns": n[a:b].tobytes()} for a, b in zip(edges, edges[1:]) if b > a]
            for i in range(0, len(out), 256):
                yield pa.RecordBatch.from_pylist(out[i : i + 256], schema=_ENCODED)

        for batch in batches:
            for i, j, data, off in text_chunks(batch.column(2)):
                s, e, first = spans(data, off, BY_SPACE)
                h, n, words = span_hashes(data, s, e), j - i, np.diff(first)
                text = np.repeat(np.arange(n), words)
                place = top.find(h)
                out = np.flatnonzero(place < 0)
                # Numbers: the code's, then the end, the escape, and other words by hash; each text's last is the end.
                number = np.where(place < 0, k + 2 + (h % U(OTHERS)).astype(np.int64), place)
                ids = np.full(len(h) + n, k, np.int64)
                ids[np.arange(len(h)) + text] = number
                raw, woff = gather(data, s[out], e[out])
                own = np.searchsorted(out, first)  # of each text's first other word
                woff32 = woff[own].astype(np.int32)
                known = np.bincount(text, known_at[place], n) + (ends > 0)
                base = np.bincount(text, base_of[place], n) + end_base
                size = np.bincount(text, e - s, n).astype(np.int64) + words + 1
                tail.append((h[out], rows + text[out]))
                none = lambda kind: pa.nulls(n, kind)  # noqa: E731, B023
                yield pa.record_batch([
                    batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(np.full(n, block)), pa.array(np.arange(rows, rows + n, dtype=np.int32)), pa.array(words + 1), pa.array(size), pa.array(known.astype(np.int64)), pa.array(base),
                    pa.ListArray.from_arrays(pa.array((first + np.arange(n + 1)).astype(np.int32)), pa.array(ids.astype(np.int32))),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(woff32), pa.py_buffer(raw)]),
                    pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(np.diff(woff).astype(np.int32))),
                    none(pa.int32()), none(pa.binary()), none(pa.binary()), none(pa.binary()),
                ], schema=_ENCODED)
                rows += n
                if sum(len(x[0]) for x in tail) > 1 << 21 or rows > 1 << 23:
                    yield from flush()
                    block, rows = block + 1, 0
        if tail:
            yield from flush()

    return run


def _parts(batches: Iterator[pa.RecordBatch], at: int, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Rows of about `most` tokens at a time; a longer text is a part of its own. Column `at` has the tokens."""
    for batch in batches:
        off, i = batch.column(at).offsets.to_numpy().astype(np.int64), 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def _arrays(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, ...]:
    """(ids, their offsets by text, words' bytes, words' offsets, each word's text) of the columns from `at` on."""
    ids, words, lens = (batch.column(at + i) for i in range(3))
    off, own = ids.offsets.to_numpy().astype(np.int64), lens.offsets.to_numpy().astype(np.int64)
    raw = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
    woff = np.concatenate(([0], np.cumsum(lens.flatten().to_numpy().astype(np.int64))))
    return ids.flatten().to_numpy(), off - off[0], raw, woff, np.repeat(np.arange(len(lens)), np.diff(own))


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: first all low bytes; what is mostly zeros packs well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(x: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _slots(tree, bits: int):
    """(ids, words, lens) -> (block, width, n): the tables' counts, cut in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(2 * sum(cm.sizes(bits)), np.uint32)
        total = np.split(flat, np.cumsum([2 * n for n in cm.sizes(bits)])[:-1])
        some = False
        for batch in _parts(batches, 0):
            ids, off, raw, woff, _ = _arrays(batch, 0)
            cm.count_into(total, tree.value, ids, off, raw, woff, bits)
            some = some or batch.num_rows > 0
        if some:
            for b, x in enumerate(np.array_split(flat.reshape(-1, 2), BLOCKS)):
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([4], pa.int32()), pa.array([_planes(x.ravel())], pa.binary())], ["block", "width", "n"])

    return run


def _sum_slots(last: bool):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for width, x in zip(batch.column("width").to_pylist(), batch.column("n").to_pylist(), strict=True):
                x = _from_planes(x, width).astype(np.uint64)
                total = x if total is None else total + x
        out = cm.packed(total.reshape(-1, 2)).tobytes() if last else _planes(total)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([8], pa.int32()), pa.array([out], pa.binary())], ["block", "width", "n"])

    return run


def _tables(share, bits: int) -> list[np.ndarray]:
    return np.split(np.frombuffer(share.value, np.uint16), np.cumsum(cm.sizes(bits))[:-1])


def _cells(tree, share, bits: int):
    """(ids, words, lens) -> (at, n): cells of the decisions with their counts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, states, some = np.zeros((2, cm.CELLS, 2), np.uint32), cm.left_out(_tables(share, bits)), False
        for batch in _parts(batches, 0):
            ids, off, raw, woff, _ = _arrays(batch, 0)
            cm.histogram(total, states, tree.value, ids, off, raw, woff, bits)
            some = True
        if some:
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array([at.astype(np.int64).tobytes()], pa.binary()), pa.array([total.ravel()[at].astype(np.int64).tobytes()], pa.binary())], ["cell", "n"])

    return run


def _sum_cells(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(4 * cm.CELLS, np.int64)
    for batch in batches:
        for at, n in zip(batch.column("cell").to_pylist(), batch.column("n").to_pylist(), strict=True):
            total[np.frombuffer(at, np.int64)] += np.frombuffer(n, np.int64)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array([at.astype(np.int64).tobytes()], pa.binary()), pa.array([total[at].tobytes()], pa.binary()), pa.array([key[0].as_py()], pa.int32())], ["cell", "n", "one"])


def _scores(tree, share, logs, bits: int, width: int):
    """(columns of a text, ids, words, lens) -> (those columns, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = cm.as_seen(_tables(share, bits))
        for batch in _parts(batches, width):
            ids, off, raw, woff, owner = _arrays(batch, width)
            score = cm.text_scores(logs.value, states, tree.value, ids, off, raw, woff, owner, bits)
            yield pa.record_batch([*batch.columns[:width], pa.array(score)], [*batch.schema.names[:width], "score"])

    return run


def _met(total: int, distinct: int):
    """Tail tokens and counted tokens of one hash range -> (block, ats, known, base) sums by text, as arrays."""

    def run(tail: pa.Table, tokens: pa.Table) -> pa.Table:
        h = tokens.column("h").to_numpy().view(U)
        order = np.argsort(h)
        h, c = h[order], tokens.column("c").to_numpy()[order]
        rows = []
        for block, hs, ats, ns in zip(*[tail.column(k).to_pylist() for k in ("block", "hs", "ats", "ns")], strict=True):
            x, at, times = np.frombuffer(hs, U), np.frombuffer(ats, np.int32), np.frombuffer(ns, np.int32)
            own = np.zeros(len(x), np.int64)
            if len(h):
                place = np.minimum(np.searchsorted(h, x), len(h) - 1)
                own = np.where(h[place] == x, c[place], 0)
            texts, back = np.unique(at, return_inverse=True)
            n = len(texts)
            rows.append((block, texts.tobytes(), np.bincount(back, times * (own > 0), n).tobytes(), np.bincount(back, times * np.log10((own + 1.0) / (total + distinct + 1.0)), n).tobytes()))
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), **{k: pa.array([r[i] for r in rows], pa.binary()) for i, k in enumerate(("ats", "known", "base"), 1)}})

    return run


def _by_text(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((0, 2))
    for batch in batches:
        for ats, *parts in zip(*[batch.column(k).to_pylist() for k in ("ats", "known", "base")], strict=True):
            at = np.frombuffer(ats, np.int32)
            if len(at) and at[-1] >= len(sums):
                sums = np.concatenate([sums, np.zeros((at[-1] + 1 - len(sums), 2))])
            sums[at] += np.stack([np.frombuffer(p) for p in parts], axis=1)
    for i in range(0, len(sums), 20_000):
        part = sums[i : i + 20_000]
        n = len(part)
        yield pa.record_batch([pa.array([key[0].as_py()] * n, pa.int64()), pa.array(np.arange(i, i + n, dtype=np.int32)), pa.array(part[:, 0].astype(np.int64)), pa.array(part[:, 1])], ["block", "at", "known", "base2"])


def _least_of(vocab: DataFrame, top: int) -> int:
    """The least count, 2 or more, that at most `top` tokens have or exceed, to a quarter of a power of two."""
    steps = vocab.where("c > 1").groupBy(F.floor(F.log2("c") * 4).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect()
    least = max([1, *(r.least for r in steps)]) * 2
    for r in sorted(steps, key=lambda r: -r.s):
        top -= r.n
        if top < 0:
            break
        least = r.least
    return int(least)


def train_and_score(docs: DataFrame, parts: int = 7, held: int = 2, top: int = TOP) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one
    row for each row of docs.

    Texts whose crc32 of doc_id modulo `parts` is not `held` are learnt from; a null doc_id counts as the empty text. A
    null or empty text is the end token alone. base_score sums log10((c + 1) / (N + V + 1)) over tokens; score is the
    model's log10 probability of the text, bits_per_byte the same over the bytes of its words and a byte for each token's
    end. Repeated rows are learnt from and scored each on its own; ties cannot arise; very long texts and words are whole.
    An empty table gives no rows; without training texts N and V are 0 and the predictors know nothing. Other columns are
    ignored. Tokens are told apart by 64-bit hashes. Whatever the partitioning, the model is the same; scores agree up to
    the order of additions.
    """
    spark = docs.sparkSession
    with modest_batches(spark):
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), parts) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
        train = docs.where("not held_out")
        size, ends = train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
        range_bits = min(max(int(size // RANGE_BYTES).bit_length(), 4), 16)
        counted = train.select("text").mapInArrow(_counts(range_bits), "r int, hs binary, cs binary")
        vocab = settle(counted.groupBy("r").applyInArrow(_range_counts, "h long, c long"), "vocab")
        words, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        total, distinct = int(words) + int(ends), int(distinct) + (ends > 0)

        least = _least_of(vocab, top)
        frequent = vocab.where(F.col("c") >= least).toArrow()
        best = Top(frequent.column("h").to_numpy().view(U), frequent.column("c").to_numpy())
        covered = int(best.c.sum())
        share = spark.sparkContext.broadcast(best)
        tree = spark.sparkContext.broadcast(cm.Tree(np.concatenate((best.c, [ends, words - covered + 1]))))
        fragment_bits = max(4, int(np.ceil(np.log2(max(1, (words - covered) / 1_000_000 + distinct / 100_000)))))
        encoded = settle(docs.mapInArrow(_encoded(share, int(ends), total, distinct, fragment_bits), _ENCODED_KIND), "encoded")

        # Each counting task returns whole tables, so there is one for so many tokens, whatever the partitions.
        bits = cm.bits_for(int(words))
        own = encoded.where("not held_out").select("ids", "words", "lens")
        few = max(spark.sparkContext.defaultParallelism, int(words) // TASK_TOKENS)
        slots, kind = own.coalesce(few).mapInArrow(_slots(tree, bits), "block int, width int, n binary"), "block int, width int, n binary"
        slots = slots.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN))).groupBy("block", "part").applyInArrow(_sum_slots(False), kind)
        slots = slots.groupBy("block").applyInArrow(_sum_slots(True), kind).collect()
        tables = b"".join(bytes(r.n) for r in sorted(slots, key=lambda r: r.block)) if slots else bytes(2 * sum(cm.sizes(bits)))
        del slots
        model = spark.sparkContext.broadcast(tables)
        del tables

        seen = own.mapInArrow(_cells(tree, model, bits), "cell binary, n binary")
        seen = seen.withColumn("one", F.pmod(F.spark_partition_id(), F.lit(FAN))).groupBy("one").applyInArrow(_sum_cells, "cell binary, n binary, one int")
        seen = seen.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_sum_cells, "cell binary, n binary, one int").collect()
        histogram = np.zeros(4 * cm.CELLS, np.int64)
        for r in seen:
            histogram[np.frombuffer(bytes(r.cell), np.int64)] = np.frombuffer(bytes(r.n), np.int64)
        ones = [cm.learn(x) for x in histogram.reshape(2, cm.CELLS, 2)]
        logs = spark.sparkContext.broadcast(np.stack([np.log10(np.stack([1 - p, p], axis=1)).ravel() for p in ones]))

        columns = ["doc_id", "held_out", "block", "at", "n_tokens", "n_bytes", "n_known", "base"]
        texts = encoded.where("at is not null").select(*columns, "ids", "words", "lens")
        scored = texts.mapInArrow(_scores(tree, model, logs, bits, len(columns)), "doc_id long, held_out boolean, block long, at int, n_tokens long, n_bytes long, n_known long, base double, score double")

        tail = encoded.where("hs is not null").select("frag", "block", "hs", "ats", "ns").groupBy("frag")
        range_of = F.shiftrightunsigned("h", 64 - fragment_bits).cast("int")
        tokens = vocab.where(F.col("c") < least).select(range_of.alias("frag"), "h", "c").groupBy("frag")
        met = tail.cogroup(tokens).applyInArrow(_met(total, distinct), "block long, ats binary, known binary, base binary")
        rest = met.groupBy("block").applyInArrow(_by_text, "block long, at int, known long, base2 double")
        out = settle(scored, "scored").join(rest, ["block", "at"], "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        return settle(out.select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + zero("base2")).alias("base_score"), "score", (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
        ), "lm_scores")
