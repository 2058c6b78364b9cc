"""Importance resampling towards a target distribution, over hashed word and word-pair features.

Each partition keeps a trie of words: a node of the first level is a word, one of the second a word after it, and each
holds how often its path occurs and the CRC state that its path leaves, so that a child's feature is hashed from its
parent's state on. A partition adds its nodes' counts up by bucket; the buckets' totals are the only thing that is
shuffled, and 10,000 of them say each bucket's gain. Documents are then scored by walking the same tries, whose nodes hold
the gains, and the highest of weight plus Gumbel noise are drawn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import settle, with_columns
from siltstone.sources.tables import numbered

#: Buckets of features.
BUCKETS = 10_000
#: Nodes that a trie grows to before its counts are added up and it starts afresh.
NODES = 1_500_000
#: Words that are walked at once.
WORDS = 300_000
#: Bytes that are not part of a word become spaces, A-Z become a-z.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Trie:
    """Nodes of the first level by word, of the second by (first word's node, second word's node), sorted."""

    def __init__(self, gains: np.ndarray | None = None):
        self.gains = gains
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.spaced: list[bytes] = []
        self.states = np.zeros(0, np.uint32)
        self.counts = np.zeros(0, np.int64)
        self.edges = np.zeros(0, np.int64)
        self.edge_states = np.zeros(0, np.uint32)
        self.edge_counts = np.zeros(0, np.int64)

    def walk(self, words: list[bytes]) -> np.ndarray:
        """The words' nodes of the first level, made where there are none."""
        known, fresh = self.words, {}
        for w in set(words).difference(known):
            fresh[w] = len(known) + len(fresh)
        known.update(fresh)
        self.spaced += [b" " + w for w in fresh]
        self.states = np.concatenate((self.states, np.fromiter(map(crc32, fresh), np.uint32, len(fresh))))
        self.counts = np.append(self.counts, np.zeros(len(fresh), np.int64))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def grow(self, edges: np.ndarray) -> None:
        """Makes the nodes of the second level that are not there; edges are different ones, in order."""
        at = np.searchsorted(self.edges, edges)
        new = edges[(at == len(self.edges)) | (np.append(self.edges, -1)[at] != edges)]
        spaced, states = self.spaced, self.states
        state = np.fromiter((crc32(spaced[b], s) for s, b in zip(states[new >> 32].tolist(), (new & 0xFFFFFFFF).tolist(), strict=True)), np.uint32, len(new))
        to = np.searchsorted(self.edges, new)
        self.edges = np.insert(self.edges, to, new)
        self.edge_states = np.insert(self.edge_states, to, state)
        self.edge_counts = np.insert(self.edge_counts, to, 0)

    def __len__(self) -> int:
        return len(self.words) + len(self.edges)

    def pairs(self, nodes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges, place of their first word) of the words that follow another in their text."""
        last = np.cumsum(sizes)[sizes > 0] - 1
        inner = np.ones(len(nodes), bool)
        inner[last] = False
        at = np.flatnonzero(inner)
        return (nodes[at] << 32) | nodes[at + 1], at

    def count(self, words: list[bytes], sizes: np.ndarray) -> None:
        nodes = self.walk(words)
        self.counts += np.bincount(nodes, minlength=len(self.counts))
        edges, times = np.unique(self.pairs(nodes, sizes)[0], return_counts=True)
        self.grow(edges)
        self.edge_counts[np.searchsorted(self.edges, edges)] += times

    def totals(self) -> np.ndarray:
        """How often each bucket's features occur."""
        out = np.bincount(self.states % BUCKETS, self.counts, BUCKETS) + np.bincount(self.edge_states % BUCKETS, self.edge_counts, BUCKETS)
        return out.astype(np.int64)

    def score(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """The sum of the gains on each text's paths."""
        nodes = self.walk(words)
        pairs, at = self.pairs(nodes, sizes)
        edges, back = np.unique(pairs, return_inverse=True)
        self.grow(edges)
        gain = self.gains[self.states % BUCKETS][nodes]
        gain[at] += self.gains[self.edge_states[np.searchsorted(self.edges, edges)] % BUCKETS][back]
        return np.diff(np.concatenate(([0], np.cumsum(gain)))[np.concatenate(([0], np.cumsum(sizes)))])


def _parts(column: pa.Array) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(rows, words, words in each row) of some rows at a time."""
    rows, words, sizes = 0, [], []
    for text in column:
        found = (text.as_py() or b"").translate(_LOWER).split()
        words += found
        sizes.append(len(found))
        rows += 1
        if len(words) > WORDS:
            yield rows, words, np.array(sizes)
            rows, words, sizes = 0, [], []
    if rows:
        yield rows, words, np.array(sizes)


def _texts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col("text").cast("string").cast("binary").alias("text"), *[F.col(f"`{c}`") for c in keep])


def bucket_totals(texts: DataFrame) -> DataFrame:
    """texts (text) -> (bucket, n): how often features of the bucket occur; buckets without features have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = Trie(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, words, sizes in _parts(batch.column(0)):
                trie.count(words, sizes)
                if len(trie) > NODES:
                    total += trie.totals()
                    trie.clear()
        total += trie.totals()
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return _texts(texts).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> list[int]:
    """Each bucket's gain: floor(1000 ln of how much likelier the target is to have its features, each count plus one)."""
    s, t = [0] * BUCKETS, [0] * BUCKETS
    for totals, frame in ((s, raw), (t, target)):
        for r in bucket_totals(frame).collect():  # BUCKETS rows at most
            totals[r.bucket] = r.n
    big_s, big_t = float(sum(s) + BUCKETS), float(sum(t) + BUCKETS)
    return [math.floor(1000.0 * math.log(((b + 1.0) * big_s) / ((a + 1.0) * big_t))) for a, b in zip(s, t, strict=True)]


def score_documents(docs: DataFrame, gain: list[int], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs -> (*keep, n_words, n_features, weight): weight is the floored mean of the gains of a text's features, 0 for
    none. A null text has no words."""
    schema = with_columns([docs.schema[c] for c in keep], "n_words long, n_features long, weight long")
    names, share = schema.names, docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(share.value)
        for batch in batches:
            at = 0
            for rows, words, sizes in _parts(batch.column(0)):
                features = sizes + np.maximum(sizes - 1, 0)
                weight = trie.score(words, sizes) // np.maximum(features, 1)
                yield pa.record_batch([*(c.slice(at, rows) for c in batch.columns[1:]), pa.array(sizes, pa.int64()), pa.array(features, pa.int64()), pa.array(weight, pa.int64())], names)
                at += rows
                if len(trie) > NODES:
                    trie.clear()

    return _texts(docs, keep).mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """docs (doc_id, text), target (text) -> (doc_id, n_words, n_features, weight, score, rank) of every row.

    Words are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII; features are words and words
    joined with the next one by a space, repeats counted, in the bucket of their bytes' CRC-32. score is weight plus Gumbel
    noise, in thousandths, by the sha256 of seed and doc_id. Of the N rows with least_words or more, rank numbers the
    floor(percent * N / 100) with the highest scores from 1; other rows have null.

    Ties go to the smaller doc_id, null first (its noise is that of an empty id), then to fewer features, less weight, and
    the smaller hash of the text; rows equal in all of these are interchangeable. Null and empty texts have no features
    and weight 0. Repeated rows are drawn each on its own. Other columns are ignored, whatever their names. Empty tables
    give no rows, or gains from no features. What is broadcast are 10,000 numbers, whatever the corpus.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    scored = score_documents(docs, gains(docs, target), keep=("doc_id", "text_hash"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = settle(scored.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    able = scored.where(F.col("n_words") >= least_words).withColumn("below", -F.col("score"))
    drawn = able.count() * percent // 100
    placed = numbered(able, "below", "doc_id", "n_features", "weight", "text_hash", name="place", start=1).drop("below")
    placed = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).drop("text_hash")
