"""Byte-pair encoding by a tokenization automaton: its arcs are tokens, its paths the correct tokenizations of words.

The automaton begins with one state, which every single symbol leads back to. Merges are compiled in their order, each by
a gadget: for (u, v) -> w the state that u leads to becomes a state of u's own, a copy without the arc v; and from every
state with an arc u a new arc w leads where v led from there. So a token leads to one state wherever it starts, and what
has to be kept is a target for each token and, for each token, the states that have its arc: bits, equal ones once.

A word is encoded by running the automaton along the arcs whose labels match: each beginning of a word has one correct
tokenization, so a place in the word is reached by one arc only. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import with_columns

#: The pre-splitting that the file's pattern names, over letters and numbers as classes (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words, and pieces between white space, whose tokens a worker remembers; then it starts afresh.
REMEMBERED = 300_000
#: Rows of texts that are turned at a time.
ROWS = 256


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it is one, the others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


@dataclass
class Automaton:
    """target: the state after each token; kind: the row of `arcs` with the states (as bits) that have the token's arc;
    labels: each token's text, in the symbols of bytes; suffix: what ends a word's last token; special: whole strings of
    a text that are tokens as they stand."""

    target: np.ndarray
    kind: np.ndarray
    arcs: np.ndarray
    labels: list[str]
    suffix: str
    special: dict[str, int]
    longest: int = 0
    _trie: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.longest = max(map(len, self.labels), default=0)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_trie": {}}

    @property
    def states(self) -> int:
        return int(self.target.max()) + 1

    def trie(self) -> dict:
        """Labels by characters; "" ends a label within a word, the suffix one at its end."""
        if not self._trie:
            specials = set(self.special.values())
            for t, label in enumerate(self.labels):
                if t in specials or not label:
                    continue
                last = bool(self.suffix) and label.endswith(self.suffix)
                node = self._trie
                for c in label[: -len(self.suffix)] if last else label:
                    node = node.setdefault(c, {})
                row = self.arcs[self.kind[t]].tobytes()
                node[self.suffix if last else ""] = (t, int(self.target[t]), row)
        return self._trie

    def encode(self, word: str) -> list[int]:
        """The tokens of a word in the symbols of bytes."""
        if not word:
            return []
        path: list[int] = []
        open_arcs = [self._matching(word, 0, 0)]
        while open_arcs:
            if not open_arcs[-1]:
                open_arcs.pop()
                if path:
                    path.pop()
                continue
            end, state, (token, after, states) = open_arcs[-1].pop()
            if states[state >> 3] >> (state & 7) & 1:
                path.append(token)
                if end == len(word):
                    return path
                open_arcs.append(self._matching(word, end, after))
        raise ValueError(f"no path for a word of {len(word)} symbols: the vocabulary lacks one of them")

    def _matching(self, word: str, at: int, state: int) -> list[tuple]:
        """(end, state, arc) of the labels that a word goes on with from a place, the longest last. A place is reached
        once at most, so trying the longest first and going back costs no more than going through all places."""
        node, out, end = self.trie(), [], at
        for c in word[at : at + self.longest]:
            node = node.get(c)
            if node is None:
                return out
            end += 1
            arc = node.get("" if end < len(word) else self.suffix)
            if arc is not None:
                out.append((end, state, arc))
        return out

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels; a file without a decoder puts a space between them."""
        return " ".join([self.labels[i] for i in ids])


def compile_merges(base: list[int], merges: list[tuple[int, int, int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target, kind, arcs) of the automaton for `size` tokens: single symbols `base`, then merges (u, v, w) in order.

    Each merge's parts must be there before it, and its result must be new: then the order of the merges says all that
    an encoder does. A merge adds at most one state.
    """
    there = np.zeros(size, bool)
    there[base] = True
    # By state, a bit for each token while states are copied; by token, a bit for each state in the end.
    arcs = np.zeros((1024, size // 8 + 1), np.uint8)
    np.bitwise_or.at(arcs[0], np.array(base, int) >> 3, np.left_shift(1, np.array(base, int) & 7).astype(np.uint8))
    target = np.zeros(size, np.int32)
    never: set[int] = set()
    users, states = [len(base) + 1], 1  # the first state is also where words begin, so it is never u's own
    for u, v, w in merges:
        if not (there[u] and there[v]) or there[w]:
            raise ValueError(f"merge of {u} and {v} into {w}: its parts must come before it, its result after")
        there[w] = True
        s = int(target[u])
        if u in never or not arcs[s, v >> 3] >> (v & 7) & 1:
            never.add(w)  # earlier merges leave no u before v
            continue
        target[w] = target[v]
        users[target[w]] += 1
        if users[s] > 1:  # a copy of the state for u alone
            if states == len(arcs):
                arcs = np.pad(arcs, ((0, states), (0, 0)))
            arcs[states] = arcs[s]
            users[s] -= 1
            users.append(1)
            target[u] = s = states
            states += 1
        arcs[s, v >> 3] &= np.uint8(255 ^ (1 << (v & 7)))
        arcs[:states, w >> 3] |= (arcs[:states, u >> 3] >> np.uint8(u & 7) & np.uint8(1)) << np.uint8(w & 7)
    by_token = np.zeros((8 * arcs.shape[1], states // 8 + 1), np.uint8)
    for i in range(0, arcs.shape[1], 256):
        bits = np.unpackbits(arcs[:states, i : i + 256], axis=1, bitorder="little")
        by_token[8 * i : 8 * i + bits.shape[1], : (states + 7) // 8] = np.packbits(bits.T, axis=1, bitorder="little")
    by_token = by_token[:size]
    rows: dict[bytes, int] = {}
    kind = np.array([rows.setdefault(x.tobytes(), len(rows)) for x in by_token], np.int32)
    return target, kind, np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def load(path: str) -> Automaton:
    """The automaton of a tokenizer file: lower case, white space dropped, words split by PATTERN, byte symbols, BPE."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    m = d["model"]
    kinds = [x["type"] for x in (d["normalizer"] or {}).get("normalizers", [])]
    splits = [x.get("pattern", {}).get("Regex") for x in (d["pre_tokenizer"] or {}).get("pretokenizers", [])]
    plain = not (m.get("dropout") or m.get("continuing_subword_prefix") or m.get("byte_fallback") or m.get("ignore_merges") or m.get("unk_token"))
    if m["type"] != "BPE" or not plain or kinds != ["NFC", "Replace", "Lowercase"] or splits[:1] != [PATTERN] or d["decoder"] or d["post_processor"]:
        raise ValueError("only byte-level BPE with NFC, lower case, this pattern and no decoder is known")
    vocab, suffix = m["vocab"], m.get("end_of_word_suffix") or ""
    special = {x["content"]: x["id"] for x in d["added_tokens"]}
    labels = [""] * (max([*vocab.values(), *special.values()]) + 1)
    for label, i in [*vocab.items(), *special.items()]:
        labels[i] = label
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
    merges = [(vocab[a], vocab[b], vocab[(a + b)]) for a, b in pairs]
    made = {w for _, _, w in merges}
    base = [i for i in vocab.values() if i not in made]
    return Automaton(*compile_merges(base, merges, len(labels)), labels, suffix, special)


def _ranges(test) -> str:
    """The characters that pass a test, as ranges of a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        if c <= sys.maxunicode and test(chr(c)):
            start = c if start is None else start
        elif start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: Characters with the property White_Space (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


class Encoder:
    """Texts to tokens: special strings, then pieces between white space, then words, then the automaton."""

    def __init__(self, automaton: Automaton):
        self.a = automaton
        self.spaces = re.compile(f"[{SPACE}]+").split
        letters, numbers = (_ranges(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
        spaced = PATTERN.replace(r"\s", SPACE)
        self.words = re.compile(spaced.replace(r"\p{L}", letters).replace(r"\p{N}", numbers)).findall
        self.ascii_words = re.compile(spaced.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")).findall
        # White space to Python but not by the property: texts with one are split the slow way.
        self.odd = re.compile("[\x1c-\x1f]").search
        self.special = re.compile("|".join(map(re.escape, sorted(automaton.special, key=len, reverse=True)))) if automaton.special else None
        self.symbols = byte_symbols()
        self.known: dict[str, tuple[bytes, str]] = {}
        self.coded: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        """The tokens of a piece without white space."""
        out, at = [], 0
        for found in self.special.finditer(piece) if self.special else ():
            out += [*self.plain(piece[at : found.start()]), self.a.special[found.group()]]
            at = found.end()
        return out + self.plain(piece[at:])

    def plain(self, piece: str) -> list[int]:
        # A capital sigma's lower case does not depend on its place.
        if piece.isascii():
            words = self.ascii_words(piece.lower())
        else:
            words = self.words(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
        out, coded = [], self.coded
        for w in words:
            tokens = coded.get(w)
            if tokens is None:
                if len(coded) > REMEMBERED:
                    coded.clear()
                tokens = coded[w] = self.a.encode("".join([self.symbols[b] for b in w.encode()]))
            out += tokens
        return out

    def text(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit numbers, labels with a space between) of a whole text."""
        known, ids, labels = self.known, [], []
        if len(known) > REMEMBERED:
            known.clear()
        for p in self.spaces(text) if self.odd(text) else text.split():
            found = known.get(p)
            if found is None:
                tokens = self.piece(p)
                found = known[p] = (np.array(tokens, "<u4").tobytes(), self.a.decode(tokens))
            if found[0]:
                ids.append(found[0])
                labels.append(found[1])
        return b"".join(ids), " ".join(labels)


#: A worker's encoder, kept from task to task.
_ENCODERS: dict[str, Encoder] = {}


def encode_documents(docs: DataFrame, path: str, column: str = "text", keep: tuple[str, ...] = ("doc_id",), with_tokens: bool = False) -> DataFrame:
    """docs -> (*keep, n_tokens, ids_sha256, decoded_sha256[, ids array<long>, decoded]) of each row's whole text.

    path names a tokenizer file that the driver reads; what workers get is the automaton, whose size is set by the file
    and not by docs. A null text counts as empty: no tokens, the hashes of nothing. Strings of special tokens within a
    text are these tokens. Repeated rows, null ids and columns of any name in keep are passed on; keep may not name a
    result. A text is one row's work, in time linear in its length. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(path))
    key = uuid.uuid4().hex
    own = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_tokens else "")
    schema = with_columns([docs.schema[c] for c in keep], own)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(shared.value)
        encoder = _ENCODERS[key]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, ids, decoded, rows, texts = [], [], [], [], []
                for text in part.column(0).to_pylist():
                    raw, labels = encoder.text(text or "")
                    n.append(len(raw) // 4)
                    ids.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(labels.encode()).hexdigest())
                    if with_tokens:
                        rows.append(np.frombuffer(raw, "<u4").astype(np.int64))
                        texts.append(labels)
                more = [pa.array(rows, pa.list_(pa.int64())), pa.array(texts, pa.string())] if with_tokens else []
                yield pa.record_batch([*part.columns[1:], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), *more], names)

    text = F.col(f"`{column}`").cast("string").alias("text")
    return docs.select(text, *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
