"""Runs of repeating words by the suffix tree of each text.

The tree is that of Stoye and Gusfield's algorithm, in arrays: suffixes in order by doubling, the intervals of common
beginnings as nodes. Two leaves i and i + D under a node of depth D are a tandem repeat of period D at i, and it branches
if it cannot be shifted to the right. At each node only the leaves outside its largest child look for their partners, on
both sides, so a leaf looks as often as halving its text allows. Each branching repeat is rotated to the left as far as
it goes, which gives its run; of repeats that give one run the smallest period is the run's.

Many texts are done at once: a word is told apart by its text too, so that no suffix equals another text's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import with_columns

#: Words of texts that are done at once; a longer text is done alone.
WORDS = 200_000


class _Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def _suffixes(name: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffixes in order, place of each, levels): level k's numbers are equal where 2**k words are. Words that are there
    fewer than `least` times equal none, their own other places included; one more place, after the end, equals none."""
    n = len(name)
    order = np.argsort(name, kind="stable")
    sorted_name = name[order]
    edge = np.concatenate(([True], sorted_name[1:] != sorted_name[:-1]))
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, n))
    group = np.repeat(start, size)
    slots = np.flatnonzero(np.repeat(size, size) >= least)
    group_of = np.arange(n)
    group_of[slots] = group[slots]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = group_of
    levels, h = [rank.astype(np.int32)], 1
    while len(slots):
        at = order[slots]
        key = rank[at] * (n + 1) + rank[at + h] + 1
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        edge = np.concatenate(([True], key[1:] != key[:-1]))
        first = slots[np.flatnonzero(edge)[np.cumsum(edge) - 1]]
        rank[at] = first
        alone = edge & np.append(edge[1:], True)
        levels.append(rank.astype(np.int32))
        slots = slots[~alone]
        h *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place, levels


def _common(order: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """For each place in the order how many words the suffix has in common with the one before, within stretches in which
    `least` suffixes have them; elsewhere what more suffixes have. One more place, 0, at the end."""
    n = len(order)
    common = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    x, y = order[at - 1], order[at]
    upto = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        upto += (levels[k][x + upto] == levels[k][y + upto]).astype(np.int64) << k
    common[at] = upto
    # Erosion, then dilation: stretches of fewer than least - 1 neighbours go, others stay as they are.
    w = least - 1
    padded = np.pad(common, w)
    low = np.lib.stride_tricks.sliding_window_view(padded, w).min(axis=1)
    return np.lib.stride_tricks.sliding_window_view(low, w).max(axis=1)[1 : n + 2]


def _tree(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first leaf, last leaf, depth, parent or -1) of each inner node but the root, and each leaf's parent or -1."""
    changes = np.flatnonzero(np.concatenate(([True], common[1:] != common[:-1])))
    lefts, rights, depths, parents, top, opened = [], [], [], [], [], []
    for s, depth in zip(changes.tolist(), common[changes].tolist(), strict=True):
        left, last = s - 1, -1
        while top and depths[top[-1]] > depth:
            node = top.pop()
            rights[node] = s - 1
            if last >= 0:
                parents[last] = node
            last, left = node, lefts[node]
        if depth:
            if not top or depths[top[-1]] < depth:
                top.append(len(lefts))
                lefts.append(left)
                rights.append(-1)
                depths.append(depth)
                parents.append(-1)
            if last >= 0:
                parents[last] = top[-1]
        opened.append(top[-1] if top else -1)
    node = np.repeat(np.array(opened, np.int64), np.diff(np.append(changes, len(common))))
    leaf_parent = np.where(common[1:] > common[:-1], node[1:], node[:-1])
    return np.array(lefts, np.int64), np.array(rights, np.int64), np.array(depths, np.int64), np.array(parents, np.int64), leaf_parent


def _heavy_tops(left: np.ndarray, right: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """For each node the node above it where the way up through largest children ends."""
    n = len(left)
    by = np.lexsort((left, right - left, parent))
    largest = by[np.append(parent[by][1:] != parent[by][:-1], True)] if n else by
    up = np.arange(n)
    largest = largest[parent[largest] >= 0]
    up[largest] = parent[largest]
    while not np.array_equal(further := up[up], up):
        up = further
    return up


def runs_of(words: np.ndarray, texts: np.ndarray, times: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of max(least, times * period) words or more, by start, then period. words: a
    number for each word; texts: the text it is in, in order. Runs do not go from a text into the next."""
    none = (np.zeros(0, np.int64),) * 3
    n = len(words)
    if n < times or times < 2:
        if times < 2:
            raise ValueError("a repeat is two times at least")
        return none
    name = texts * (int(words.max()) + 1) + words
    order, place, levels = _suffixes(name, times)
    left, right, depth, parent, above = _tree(_common(order, levels, times))
    if not len(left):
        return none
    top = _heavy_tops(left, right, parent)
    one = levels[0]
    leaf = np.flatnonzero(above >= 0)
    node, i = above[leaf], order[leaf]
    starts, periods = [], []
    while len(node):
        d = depth[node]
        for j in (i + d, i - d):
            there = (j >= 0) & (j < n)
            at = np.where(there, place[np.where(there, j, 0)], -1)
            s = np.minimum(i, j)
            found = np.flatnonzero((at >= left[node]) & (at <= right[node]) & (s + 2 * d <= n))
            s, p = s[found], d[found]
            branching = one[s + p] != one[s + 2 * p]
            starts.append(s[branching])
            periods.append(p[branching])
        up = parent[top[node]]
        node, i = up[up >= 0], i[up >= 0]
    start, period = np.concatenate(starts), np.concatenate(periods)
    end = start + 2 * period
    for k in range(len(levels) - 1, -1, -1):
        to = start - (1 << k)
        same = (to >= 0) & (levels[k][np.maximum(to, 0)] == levels[k][np.maximum(to, 0) + period])
        start = np.where(same, to, start)
    long = end - start >= np.maximum(least, times * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def _done(texts: list[list[bytes]], times: int, least: int) -> Iterator[tuple[list[dict], bytes]]:
    """For each text, as its words, its runs and the words that stay."""
    numbers = _Numbers()
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    words = np.concatenate([np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts])
    start, end, period = runs_of(words, np.repeat(np.arange(len(texts)), sizes), times, least)
    edges = np.searchsorted(start, first)
    for k, t in enumerate(texts):
        a, b = int(edges[k]), int(edges[k + 1])
        if a == b:
            yield [], b" ".join(t)
            continue
        s, e, q = start[a:b] - first[k], end[a:b] - first[k], period[a:b]
        gone = np.zeros(len(t) + 1, np.int64)
        np.add.at(gone, s + q, 1)
        np.add.at(gone, e, -1)
        kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
        rows = [{"start": x, "length": y - x, "period": z} for x, y, z in zip(s.tolist(), e.tolist(), q.tolist(), strict=True)]
        yield rows, b" ".join([t[x] for x in kept])


def find_runs(docs: DataFrame, times: int = 4, least: int = 6, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (text, ...) -> (*keep, n_words, runs array<struct<start, length, period>>, collapsed), a row for each row.

    Words are what ASCII white space separates, numbered from 0. A run is a stretch of words with smallest period q and
    max(least, times * q) words or more that neither neighbouring word extends keeping the period. runs are by start, then
    period; collapsed is the text, with one space between words, without the words that are in a run after its first q.
    A null or empty text has no words and no runs; collapsed is empty then, never null. Repeated rows and null ids are
    rows like others, columns not in keep are ignored, and keep may not name a result. An empty table gives no rows.
    A text is one row's work: n words take about n log n steps and some 100 bytes a word, plus four bytes a word for each
    doubling of its longest repeat. Nothing is shuffled.
    """
    schema = with_columns([docs.schema[c] for c in keep], "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    names, kind = schema.names, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, at = batch.column(0), 0
            while at < batch.num_rows:
                texts, n, to = [], 0, at
                while to < batch.num_rows and n < WORDS:
                    texts.append((column[to].as_py() or b"").split())
                    n += len(texts[-1])
                    to += 1
                out = list(_done(texts, times, least))
                rest = [c.slice(at, to - at) for c in batch.columns[1:]]
                yield pa.record_batch([*rest, pa.array([len(t) for t in texts], pa.int64()), pa.array([r for r, _ in out], kind), pa.array([c for _, c in out], pa.binary()).cast(pa.string())], names)
                at = to

    return docs.select(F.col("text").cast("string").cast("binary").alias("text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
