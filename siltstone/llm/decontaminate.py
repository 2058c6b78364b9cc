"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton holds every run of words of every item. A document's words are streamed through it; at each word it
gives the longest run of words that ends there and occurs in an item. Where no two words in a row occur together in
an item that length is known to be 0 or 1 without asking, so only the other stretches are walked.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import settle, text_chunks, with_columns
from siltstone.llm.wordarrays import BY_LETTER, span_hashes, spans

U = np.uint64
#: Bytes of item texts in one automaton; more items are taken in further passes.
BLOCK_BYTES = 8 << 20


class Automaton:
    """Suffix automaton of several word sequences; words are numbered from 1, state 0 is where every walk begins. States
    are places in flat arrays: a state's first way on is one of them, only states with several have a dictionary."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        """items: (id, hashes of its words)."""
        words = [h for _, h in items if len(h)]
        self.window = window
        self.ids = [i for i, h in items if len(h)]
        self.vocab = np.unique(np.concatenate(words)) if words else np.zeros(0, U)
        self.word, self.to, self.more = array("i", [0]), array("i", [0]), {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        sequences = [(np.searchsorted(self.vocab, h) + 1).astype(np.int32) for h in words]
        for s in sequences:
            self._add(s.tolist())
        base = len(self.vocab) + 1
        pairs = [s[:-1].astype(np.int64) * base + s[1:] for s in sequences if len(s) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.least = min([window, *(len(s) for s in sequences)])
        self.short: dict[int, list] = {}  # state of a whole short item: (words, items)
        states, owners = array("q"), array("q")  # a window's state, item
        for k, s in enumerate(sequences):
            if len(s) < window:
                v = 0
                for w in s.tolist():
                    v = self.step(v, w)
                old = self.short.setdefault(v, [])
                same = next((x for x in old if x[0] == len(s)), None)
                if same:
                    same[1].add(self.ids[k])
                else:
                    old.append((len(s), {self.ids[k]}))
            else:
                for _, v, n in self.walk(s.tolist()):
                    if n >= window:
                        states.append(self.cut(v))
                        owners.append(k)
        # Items by state: those of state v lie between owned[full[v]] and owned[full[v] + 1] in owners.
        both = np.unique(np.frombuffer(states, np.int64) * max(len(sequences), 1) + np.frombuffer(owners, np.int64)) if len(states) else np.zeros(0, np.int64)
        state, self.owners = both // max(len(sequences), 1), (both % max(len(sequences), 1)).astype(np.int32)
        first = np.flatnonzero(np.concatenate(([True], state[1:] != state[:-1]))) if len(state) else np.zeros(0, np.int64)
        self.owned = np.append(first, len(state)).astype(np.int32)
        full = np.full(len(self.link), -1, np.int32)
        full[state[first]] = np.arange(len(first))
        self.full = array("i", full.tobytes())
        if self.short:  # a suffix's marks hold too
            for v in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist()[1:]:
                if above := self.short.get(self.link[v]):
                    self.short[v] = self.short.get(v, []) + above

    def step(self, v: int, w: int) -> int:
        """The state after word w, or 0."""
        if self.word[v] == w:
            return self.to[v]
        more = self.more.get(v)
        return more.get(w, 0) if more else 0

    def _put(self, v: int, w: int, u: int) -> None:
        if self.word[v] in (0, w):
            self.word[v], self.to[v] = w, u
        else:
            self.more.setdefault(v, {})[w] = u

    def _new(self, length: int, link: int, like: int = -1) -> int:
        """A state; like: with the ways on of that one."""
        new = len(self.link)
        self.length.append(length)
        self.link.append(link)
        self.word.append(self.word[like] if like >= 0 else 0)
        self.to.append(self.to[like] if like >= 0 else 0)
        if like in self.more:
            self.more[new] = dict(self.more[like])
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for q's runs that are no longer than p's and w."""
        c = self._new(self.length[p] + 1, self.link[q], q)
        while p >= 0 and self.step(p, w) == q:
            self._put(p, w, c)
            p = self.link[p]
        self.link[q] = c
        return c

    def _add(self, sequence: list[int]) -> None:
        last = 0
        for w in sequence:
            if q := self.step(last, w):
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
                continue
            new, p = self._new(self.length[last] + 1, 0), last
            while p >= 0 and not self.step(p, w):
                self._put(p, w, new)
                p = self.link[p]
            if p >= 0:
                q = self.step(p, w)
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            last = new

    def cut(self, v: int) -> int:
        """The state of the last `window` words of a run that ends in v."""
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def windows(self, v: int) -> list:
        """The items with the window whose state is v."""
        at = self.full[v]
        return [self.ids[k] for k in self.owners[self.owned[at] : self.owned[at + 1]].tolist()] if at >= 0 else []

    def walk(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, state, longest matching length) at each word."""
        word, to, more, link, length = self.word, self.to, self.more, self.link, self.length
        v = n = 0
        for i, w in enumerate(words):
            while True:
                u = to[v] if word[v] == w else more[v].get(w, 0) if v in more else 0
                if u or not v:
                    break
                v = link[v]
                n = length[v]
            v, n = (u, n + 1) if u else (0, 0)
            yield i, v, n

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Words' numbers; 0 for words of no item."""
        at = np.searchsorted(self.vocab, hashes)
        at[at == len(self.vocab)] = 0
        return np.where(self.vocab[at] == hashes, at + 1, 0) if len(self.vocab) else np.zeros(len(hashes), np.int64)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, set]]:
        """(first word, word after the last, longest matching length there, items) of each occurrence of a window."""
        n = len(hashes)
        if not n or not len(self.vocab):
            return
        ids = self.numbers(hashes)
        known = ids > 0
        both = known[:-1] & known[1:]
        inner = first[(first > 0) & (first < n)]
        both[inner - 1] = False
        at = np.flatnonzero(both)
        if len(self.pairs):
            keys = ids[at] * (len(self.vocab) + 1) + ids[at + 1]
            j = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            both[at[self.pairs[j] != keys]] = False
        else:
            both[:] = False
        begins = np.flatnonzero(known & ~np.concatenate(([False], both)))
        ends = np.flatnonzero(known & ~np.concatenate((both, [False]))) + 1
        long = ends - begins >= self.least
        for a, b in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            for i, v, m in self.walk(ids[a:b].tolist()):
                i += a
                if m >= self.window and (owners := self.windows(self.cut(v))):
                    yield i - self.window + 1, i + 1, m, owners
                for k, owners in self.short.get(v, ()):
                    if k <= m:
                        yield i - k + 1, i + 1, m, owners


def _item_hashes(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, _, data, off in text_chunks(pa.array(texts, pa.string())):
        starts, ends, first = spans(data, off, BY_LETTER)
        h = span_hashes(data, starts, ends)
        out += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def _scan(share, text_at: int, before_at: int | None, with_text: bool, names: list[str]):
    """Adds n_words, hits (word spans), longest, items, spans and clean_text to the batches' columns; hits and items of
    an earlier pass are taken along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = share.value
        for batch in batches:
            texts = batch.column(text_at)
            for i, j, data, off in text_chunks(texts):
                starts, ends, first = spans(data, off, BY_LETTER)
                hashes = span_hashes(data, starts, ends)
                change, found, longest = np.zeros(len(hashes) + 1, np.int64), {}, np.zeros(j - i, np.int64)
                part = batch.slice(i, j - i)
                if before_at is not None:
                    for d, (old, ids) in enumerate(zip(part.column(before_at).to_pylist(), part.column(before_at + 1).to_pylist(), strict=True)):
                        for x in old:
                            change[first[d] + x["start"]] += 1
                            change[first[d] + x["end"]] -= 1
                        if ids:
                            found[d] = set(ids)
                for a, b, m, owners in automaton.hits(hashes, first):
                    change[a] += 1
                    change[b] -= 1
                    d = int(np.searchsorted(first, a, "right")) - 1
                    longest[d] = max(longest[d], m)
                    found.setdefault(d, set()).update(owners)
                hit = np.cumsum(change[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(hit)))
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
                rows_hits, rows_spans, clean = [[] for _ in range(j - i)], [[] for _ in range(j - i)], None
                cuts: dict[int, list] = {}
                for a, b in edge.reshape(-1, 2).tolist():
                    while a < b:  # a stretch may go over into the next text
                        d = int(np.searchsorted(first, a, "right")) - 1
                        e = min(b, int(first[d + 1]))
                        rows_hits[d].append({"start": a - int(first[d]), "end": e - int(first[d])})
                        cuts.setdefault(d, []).append((int(starts[a]), int(ends[e - 1])))
                        a = e
                text = part.column(text_at)
                for d, x in cuts.items():
                    raw = data[off[d] : off[d + 1]].tobytes()
                    for s, e in x:
                        at = len(raw[: s - off[d]].decode("utf-8", "replace"))
                        rows_spans[d].append({"start": at, "end": at + len(raw[s - off[d] : e - off[d]].decode("utf-8", "replace"))})
                if with_text:
                    clean = text.to_pylist() if cuts else text
                    for d, x in cuts.items():
                        raw, out, at = data[off[d] : off[d + 1]].tobytes(), [], 0
                        for s, e in x:
                            out.append(raw[at : s - off[d]])
                            at = e - off[d]
                        clean[d] = b"".join([*out, raw[at:]]).decode("utf-8", "replace")
                else:
                    clean = pa.nulls(j - i, pa.string())
                items = [sorted(x for x in found.get(d, ()) if x is not None) for d in range(j - i)]
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                kept = [c for k, c in enumerate(part.columns) if before_at is None or k < before_at]
                yield pa.record_batch([*kept, pa.array(rows_hits, span), pa.array(items, pa.list_(pa.string())), pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]]), pa.array(longest), pa.array(rows_spans, span), pa.array(clean, pa.string()) if not isinstance(clean, pa.Array) else clean.cast(pa.string())], names)

    return run


FOUND = {"hits": "array<struct<start:long,end:long>>", "items": "array<string>", "n_words": "long", "n_hit": "long", "longest": "long", "spans": "array<struct<start:long,end:long>>", "clean_text": "string"}


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, with_text: bool = False) -> DataFrame:
    """docs with columns of their own replaced or added: n_words, hits (stretches of hit words), items (ids with an
    occurring window, sorted as strings), n_hit (hit words), longest (longest matching length found at a hit), spans
    (the same stretches in code points) and, if asked for, clean_text (the text without them).

    Words are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII. A window is `window` words
    in a row of an item; a shorter item, unless empty, is one window. A word within an occurrence of a window is hit.
    A null text has no words, its clean_text is null. Items without an id are found but not listed. Repeated rows are
    treated alike, each on its own; an empty table of items hits nothing, one of documents gives no rows. Other
    columns of docs stay; those with the names above are replaced.

    The automaton is broadcast; items beyond BLOCK_BYTES of text are taken in further passes over the documents, so
    that its size is bounded whatever the items' number.
    """
    spark = docs.sparkSession
    docs = docs.drop(*FOUND)
    items = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = docs
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        rows = sorted(part.collect(), key=lambda r: (r.i or "", r.t))
        automaton = Automaton(list(zip([r.i for r in rows], _item_hashes([r.t for r in rows]), strict=True)), window)
        share = spark.sparkContext.broadcast(automaton)
        names = [*docs.columns, *FOUND]
        schema = with_columns(docs.schema, ", ".join(f"{k} {v}" for k, v in FOUND.items()))
        carried = out if b == 0 else settle(out.select(*docs.columns, "hits", "items"), "passes")
        out = carried.mapInArrow(_scan(share, docs.columns.index("text"), None if b == 0 else len(docs.columns), with_text, names), schema)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs, whatever their columns, without the hit stretches in their texts, and without the documents of which more
    than max_coverage of the words were hit; n_chars, if there, is counted anew. Cases as in find_contamination, but
    columns of docs stay whatever their names."""
    columns = docs.columns
    known, held = {c.lower() for c in columns} | set(FOUND), {}
    for c in columns:  # a column named as one of the results is set aside
        if c.lower() in FOUND:
            name = f"own_{c}"
            while name.lower() in known:
                name += "_"
            known.add(name.lower())
            held[c] = name
    named = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`").alias(held.get(c, c)) for c in columns])
    found = find_contamination(named, items, window, with_text=True)
    found = found.where((F.col("n_words") == 0) | (F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words")))
    changed = {"text": F.col("clean_text")} | ({"n_chars": F.when(F.col("n_hit") > 0, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in columns else {})
    return found.select(*[changed.get(c, F.col(f"`{held.get(c, c)}`")).alias(c) for c in columns])


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
