"""Byte-pair vocabularies of a corpus whose distinct words stay distributed.

Distinct words with their counts are a table of blocks of symbol arrays. Training goes in rounds. In a round the pairs of
neighbouring symbols are counted, and the `hot` first of them, by count, then ids, are looked at. A merge of this round can
only join symbols at places where a hot pair stands now: a pair that a merge creates is as frequent at most as the pair
that stood at its border, and of equal counts it comes after it, as its new symbol has the largest id. So words are cut
where no hot pair stands; of the pieces, equal ones counted once, the driver gets at most SEGMENTS. On them it merges pair
by pair, exactly as on the words, until a pair would come after the last hot one. Then the words are merged in place, and
the next round begins. What the driver holds does not grow with the corpus.
"""

from __future__ import annotations

import functools
import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.tables import drop_settled, settle

#: The tokens that a byte-pair vocabulary begins with (fixed values).
SPECIALS = (
    "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "<claim>", "<location>", "<incident_type>", "<label>", "<fraud_indicators>", "<statement>",
    "<insured_driver>", "<third_party_driver>", "<insurance_adjuster>", "<witness>", "<police_report>", "<expert_report>", "<vehicle>", "<speed>", "<none>", "<sep_stmt>",
)
#: Different pieces of words that the driver takes in a round, and pairs that it looks at.
SEGMENTS, PAIRS = 200_000, 100_000
#: Words in a block of the table, and words that a worker remembers.
BLOCK_WORDS, REMEMBERED = 50_000, 400_000
#: A pair of ids as one number.
WIDE = 1 << 31
POINTS = 0x110000
BLOCK_KIND = "counts binary, lengths binary, symbols binary"


#: Punctuation and symbols beyond ASCII, and the pattern that splits around those of ASCII and some of these.
_FAR = frozenset(c for c in map(chr, range(128, POINTS)) if unicodedata.category(c)[0] in "PS")
_NEAR = "".join(c for c in map(chr, range(128)) if unicodedata.category(c)[0] in "PS")


@functools.lru_cache(maxsize=1024)
def _parts(far: frozenset[str]):
    own = re.escape(_NEAR + "".join(sorted(far)))
    return re.compile(f"[{own}]|[^{own}\\s]+").findall


def pre_tokens(x: str | None) -> list[str]:
    """NFKC, split at white space and around punctuation."""
    if not x:
        return []
    if x.isascii():
        return _parts(frozenset())(x)
    x = unicodedata.normalize("NFKC", x)
    return _parts(_FAR.intersection(x))(x)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (w, n): pre-tokens with their number, after some hundred thousand kinds each time."""
    held: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["w", "n"])
        held.clear()
        return out

    for batch in batches:
        for i in range(batch.num_rows):
            held.update(pre_tokens(batch.column(0)[i].as_py()))
            if len(held) > REMEMBERED:
                yield flush()
    if held:
        yield flush()


class Vocabulary:
    """Ids: specials, then a place for each code point, then what merges make, in their order."""

    def __init__(self, specials: Sequence[str], alphabet: Sequence[int]):
        self.specials, self.tokens, self.first = list(specials), len(specials) + len(alphabet), len(specials)
        self.ids = {t: i for i, t in enumerate(specials)}
        self.names = dict(enumerate(specials))
        self.fresh = self.first + POINTS
        self.merges: list[tuple[int, int, int]] = []

    def name(self, i: int) -> str:
        return self.names.get(i) or chr(i - self.first)

    def made(self, a: int, b: int) -> int:
        """The id of what a pair is merged into; one that there is already, if its text is one."""
        text = self.name(a) + self.name(b)
        known = self.ids.get(text)
        if known is None:
            known = self.ids[text] = self.fresh
            self.names[known] = text
            self.fresh += 1
            self.tokens += 1
        self.merges.append((a, b, known))
        return known

    def named(self) -> list[tuple[str, str]]:
        return [(self.name(a), self.name(b)) for a, b, _ in self.merges]


def merge_symbols(sym: np.ndarray, lengths: np.ndarray, counts: np.ndarray, vocab: Vocabulary, size: int, least: int, last: tuple[int, int] | None = None) -> None:
    """Merges pairs of symbols, the most frequent first, of equals that of smaller ids, until vocab has `size` tokens, no
    pair is seen `least` times or the next one comes after `last` (minus its count, its ids as one number). sym: the ids
    of words of the given lengths, each there counts times. Counts are kept up to date pair by pair; places of pairs that
    are gone drop out when met."""
    sym = sym.astype(np.int32)
    of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    n = len(sym)
    before, after = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
    edge = np.cumsum(lengths)[lengths > 0]
    before[np.concatenate(([0], edge[:-1]))[: len(edge)]] = -1
    after[edge - 1] = -1
    total: dict[int, int] = {}
    places: dict[int, list[np.ndarray]] = {}
    queue: list[tuple[int, int]] = []

    def add(keys: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1)) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(counts[of[at]], cut).tolist() if len(keys) else []
        for key, s, i, j in zip(keys[cut].tolist(), sums, cut.tolist(), [*cut[1:].tolist(), len(keys)]):
            total[key] = total.get(key, 0) + s
            places.setdefault(key, []).append(at[i:j].copy())
            heapq.heappush(queue, (-total[key], key))

    at = np.flatnonzero(after >= 0).astype(np.int32)
    add(sym[at].astype(np.int64) * WIDE + sym[after[at]], at)
    while queue and vocab.tokens < size:
        seen, key = heapq.heappop(queue)
        if -seen != total.get(key, 0):
            if total.get(key, 0) > 0:
                heapq.heappush(queue, (-total[key], key))
            continue
        if -seen < max(least, 1) or last is not None and (seen, key) > last:
            break
        a, b = divmod(key, WIDE)
        at = np.unique(np.concatenate(places.pop(key)))
        at = at[(sym[at] == a) & (after[at] >= 0)]
        at = at[sym[after[at]] == b]
        if a == b and len(at):  # of a row of equal tokens, every second one begins a pair
            first = np.concatenate(([True], after[at[:-1]] != at[1:]))
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
        total.pop(key)
        new = vocab.made(a, b)
        right = after[at]
        left, following = before[at], after[right]
        inner = np.isin(following, at)  # the pair there is also the one before the next place
        l, r = left >= 0, (following >= 0) & ~inner
        gone = np.concatenate((sym[left[l]].astype(np.int64) * WIDE + a, b * WIDE + sym[following[r]].astype(np.int64)))
        weight = counts[of[np.concatenate((at[l], at[r]))]]
        sym[at], sym[right] = new, -1
        after[at] = following
        before[following[following >= 0]] = at[following >= 0]
        kinds, back = np.unique(gone, return_inverse=True)
        less = np.zeros(len(kinds), np.int64)
        np.add.at(less, back, weight)
        for k, s in zip(kinds.tolist(), less.tolist()):
            if k in total:
                total[k] -= s
        left = before[at]
        add(np.concatenate((sym[left[l]].astype(np.int64) * WIDE + new, new * WIDE + sym[following[r]].astype(np.int64))), np.concatenate((left[l], at[r])))


def learn_merges(words: pa.ChunkedArray, counts: np.ndarray, vocab_size: int, least: int = 1, specials: Sequence[str] = SPECIALS) -> list[tuple[str, str]]:
    """Byte-pair merges of a few distinct words with their counts, all held here, until specials, characters and merged
    tokens are vocab_size or no pair is seen `least` times."""
    lengths, points = _points([w for x in words.chunks for w in x.to_pylist()])
    vocab = Vocabulary(specials, np.unique(points))
    merge_symbols(points + vocab.first, lengths, counts, vocab, vocab_size, least)
    return vocab.named()


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points in each word, all code points)."""
    return np.array([len(w) for w in words], np.int64), np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)


def _block(counts: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((counts, np.int64), (lengths, np.int32), (symbols, np.int32))], ["counts", "lengths", "symbols"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(np.frombuffer(batch.column(k)[i].as_py(), t).astype(np.int64) for k, t in ((0, np.int64), (1, np.int32), (2, np.int32)))


def _to_blocks(first: int):
    """(w, n) -> blocks of symbols; words of one character have no pairs and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_WORDS):
                part = batch.slice(at, BLOCK_WORDS)
                counts, words = part.column(1).to_numpy(), part.column(0).to_pylist()
                many = np.array([len(w) > 1 for w in words], bool)
                lengths, points = _points([w for w in words if len(w) > 1])
                if len(lengths):
                    yield _block(counts[many], lengths, points + first)

    return run


def _neighbours(lengths: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of symbols that another of their word follows, the pairs there as one number)."""
    inner = np.ones(len(symbols), bool)
    inner[np.cumsum(lengths) - 1] = False
    at = np.flatnonzero(inner)
    return at, symbols[at] * WIDE + symbols[at + 1]


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> (pair, n)."""
    for counts, lengths, symbols in _blocks(batches):
        at, keys = _neighbours(lengths, symbols)
        kinds, back = np.unique(keys, return_inverse=True)
        n = np.zeros(len(kinds), np.int64)
        np.add.at(n, back, counts[np.repeat(np.arange(len(lengths)), lengths)[at]])
        yield pa.record_batch([pa.array(kinds), pa.array(n)], ["pair", "n"])


def _cut(lengths: np.ndarray, symbols: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces whose neighbours are all hot pairs, two symbols or more."""
    at, keys = _neighbours(lengths, symbols)
    place = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    joined = np.zeros(len(symbols) + 2, bool)
    joined[at[hot[place] == keys] + 1] = True
    return np.flatnonzero(joined[1:] & ~joined[:-1]), np.flatnonzero(joined[:-1] & ~joined[1:]) + 1


def _segments(hot: np.ndarray):
    """Blocks -> (piece, n): the pieces as 32-bit ids, equal ones of a block once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counts, lengths, symbols in _blocks(batches):
            starts, ends = _cut(lengths, symbols, hot)
            raw, of = symbols.astype(np.int32).tobytes(), np.repeat(np.arange(len(lengths)), lengths)
            held: dict[bytes, int] = {}
            for s, e, n in zip(starts.tolist(), ends.tolist(), counts[of[starts]].tolist(), strict=True):
                piece = raw[4 * s : 4 * e]
                held[piece] = held.get(piece, 0) + n
            yield pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["piece", "n"])

    return run


def _merged_piece(piece: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """A piece after the merges, the earliest first."""
    while len(piece) > 1:
        (rank, new), i = min((ranks.get(a * WIDE + b, (1 << 60, 0)), i) for i, (a, b) in enumerate(zip(piece, piece[1:])))
        if rank == 1 << 60:
            break
        piece = [*piece[:i], new, *piece[i + 2 :]]
    return piece


def _merged(hot: np.ndarray, merges: list[tuple[int, int, int]]):
    """Blocks -> blocks after the merges; words that are one symbol are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {a * WIDE + b: (k, new) for k, (a, b, new) in enumerate(merges)}
        known: dict[bytes, np.ndarray | None] = {}
        for counts, lengths, symbols in _blocks(batches):
            starts, ends = _cut(lengths, symbols, hot)
            raw = symbols.astype(np.int32).tobytes()
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                piece = raw[4 * s : 4 * e]
                if piece not in known:
                    if len(known) > REMEMBERED:
                        known.clear()
                    out = _merged_piece(symbols[s:e].tolist(), ranks)
                    known[piece] = np.array(out + [-1] * (e - s - len(out))) if len(out) < e - s else None
                if (new := known[piece]) is not None:
                    symbols[s:e] = new
            stays = symbols >= 0
            now = np.add.reduceat(stays.astype(np.int64), np.cumsum(lengths) - lengths)
            many = now > 1
            if many.any():
                yield _block(counts[many], now[many], symbols[stays & np.repeat(many, lengths)])

    return run


def train_bpe(docs: DataFrame, vocab_size: int = 20_000, least: int = 1, specials: Sequence[str] = SPECIALS, hot: int = 256) -> list[tuple[str, str]]:
    """Byte-pair merges of docs' (text) words, most frequent pair first, of equals that of smaller ids: specials, then
    characters by code point, then merged tokens. Until specials, characters and merged tokens are vocab_size or no pair is
    seen `least` times. Null texts have no words; an empty table gives no merges.

    hot: pairs that the first round looks at; later rounds look at more or fewer, so that their pieces are SEGMENTS or
    fewer. Results do not depend on it.
    """
    words = settle(docs.select("text").mapInArrow(_count_words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    alphabet = [r[0] for r in words.select(F.explode(F.array_distinct(F.split("w", ""))).alias("c")).distinct().collect()]
    vocab = Vocabulary(specials, sorted(map(ord, alphabet)))
    blocks = settle(words.mapInArrow(_to_blocks(vocab.first), BLOCK_KIND), "blocks")
    drop_settled(words)
    while vocab.tokens < vocab_size:
        counted = settle(blocks.mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= max(least, 1)), "pairs")
        top = counted.orderBy(F.col("n").desc(), "pair").limit(PAIRS).toPandas()
        drop_settled(counted)
        if not len(top):
            break
        hot = min(hot, len(top))
        while True:
            chosen = np.sort(top["pair"].to_numpy()[:hot])
            pieces = settle(blocks.mapInArrow(_segments(chosen), "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
            if (found := pieces.count()) <= SEGMENTS or hot == 1:
                break
            hot = max(1, hot // 4)
            drop_settled(pieces)
        few = pieces.toArrow()
        drop_settled(pieces)
        symbols = [np.frombuffer(x, np.int32) for x in few.column("piece").to_pylist()]
        done, last = len(vocab.merges), (-int(top["n"][hot - 1]), int(top["pair"][hot - 1]))
        merge_symbols(np.concatenate(symbols), np.array([len(x) for x in symbols]), few.column("n").to_numpy(), vocab, vocab_size, least, last)
        after = settle(blocks.mapInArrow(_merged(chosen, vocab.merges[done:]), BLOCK_KIND), "blocks")
        drop_settled(blocks)
        blocks = after
        hot = min(PAIRS, 2 * hot if found < SEGMENTS // 3 else hot)
    drop_settled(blocks)
    return vocab.named()


def apply_merges(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The word's tokens: the earliest merge first, of its places the leftmost."""
    parts, none = list(word), 1 << 60
    order = [ranks.get(p, none) for p in zip(parts, word[1:])]
    while order and (rank := min(order)) < none:
        i = order.index(rank)
        parts[i] += parts.pop(i + 1)
        del order[i]
        if i:
            order[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
        if i < len(order):
            order[i] = ranks.get((parts[i], parts[i + 1]), none)
    return parts


def bpe_encode(docs: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """docs (id, text) -> (id, tokens). A null text has none; characters that no merge knows are tokens of their own."""
    share = docs.sparkSession.sparkContext.broadcast(merges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {p: i for i, p in enumerate(share.value)}
        numbers: dict[str, int] = {}
        known: dict[str, bytes] = {}
        names = pa.array([], pa.string())

        def numbered(w: str) -> bytes:
            if len(known) > REMEMBERED:
                known.clear()
            out = known[w] = np.array([numbers.setdefault(t, len(numbers)) for t in apply_merges(w, ranks)], np.int32).tobytes()
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [b"".join([known.get(w) or numbered(w) for w in pre_tokens(x)]) for x in part.column(1).to_pylist()]
                if len(names) < len(numbers):
                    names = pa.array(list(numbers), pa.string())
                flat = pa.array(np.frombuffer(b"".join(rows), np.int32))
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows]))).astype(np.int32))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(offsets, names.take(flat))], ["id", "tokens"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, tokens array<string>")
