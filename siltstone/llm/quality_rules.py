"""Line-first cleaning: rules fail single lines; a document that loses too much text with them is rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import text_chunks, with_columns
from siltstone.llm.wordarrays import BY_SPACE, run_hashes, span_hashes, spans

BOILERPLATE = re.compile(
    rb"(?i)all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|accept cookies|uses cookies|enable javascript|"
    rb"click here|read more|sign up|log ?in to|subscribe to|newsletter|share this|follow us|lorem ipsum|back to top|skip to content|powered by"
)


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


SYMBOL, PIPE, SHOUT = _flags(b"#*$%&|<>"), _flags(b"|>"), _flags(b"!")
UPPER, LOWER, LEAD = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123))), np.ones(256, np.uint8)
LEAD[128:192] = 0  # bytes that begin no code point
STOP = _flags(b".!?:;\"')]}") | _flags(bytes(range(128, 256)))


def sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first line of each text and one more) of \\n-split lines; an empty text has one empty line."""
    cut = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((off[:-1], cut + 1)))
    # a line feed that ends a text leaves an empty line at its end, where the next text begins
    ends = np.sort(np.concatenate((cut, off[1:])))
    first = np.searchsorted(cut, off) + np.arange(len(off))
    return starts, ends, first


def repeated(words: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Words of each text within runs of k words that are found twice or more in it."""
    runs, out = run_hashes(words, k), np.zeros(len(first) - 1, np.int64)
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        n = b - a - k + 1
        if n < 2:
            continue
        x = runs[a : a + n]
        y = np.sort(x)
        twice = y[1:][y[1:] == y[:-1]]
        if len(twice):
            j = np.minimum(np.searchsorted(twice, x), len(twice) - 1)
            at = np.flatnonzero(twice[j] == x)
            change = np.zeros(b - a + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + k, -1)
            out[d] = np.count_nonzero(np.cumsum(change[:-1]))
    return out


def line_measures(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """What the rules ask of a chunk's words and lines."""
    ws, we, first = spans(data, off, BY_SPACE)
    hashes = span_hashes(data, ws, we, lower=False)
    ls, le, line_first = lines(data, off)
    per = lambda flags: (c := sums(flags[data]))[le] - c[ls]
    wl = np.searchsorted(ws, ls)
    n_words = np.searchsorted(ws, le) - wl
    has = n_words > 0
    last = np.zeros(len(ls), np.uint8)
    last[has] = data[we[(wl + n_words - 1)[has]] - 1] if len(data) else 0
    dup = np.zeros(len(ls), bool)
    at = np.flatnonzero(has)
    h = span_hashes(data, ls[at], le[at], lower=False) if len(at) else np.zeros(0, np.uint64)
    text_of = np.searchsorted(line_first, at, "right") - 1
    order = np.lexsort((at, h, text_of))
    same = (h[order][1:] == h[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
    dup[at[order[1:][same]]] = True
    return {"ws": ws, "we": we, "first": first, "hashes": hashes, "ls": ls, "le": le, "line_first": line_first, "n_words": n_words, "symbols": per(SYMBOL), "pipes": per(PIPE), "shouts": per(SHOUT), "upper": per(UPPER), "lower": per(LOWER), "chars": per(LEAD & BY_SPACE), "last": last, "dup": dup}


def failing_lines(m: dict[str, np.ndarray], data: np.ndarray) -> np.ndarray:
    """Lines that a rule fails; lines without a word never fail."""
    n, chars = m["n_words"], np.maximum(m["chars"], 1)
    symbols = m["symbols"] * 10 > chars  # punctuation: mostly marks
    shouting = (m["shouts"] * 4 > n) & (m["shouts"] >= 4)
    capitals = (m["upper"] > 2 * m["lower"]) & (m["upper"] >= 20)
    navigation = ((m["pipes"] >= 2) & (m["pipes"] * 4 > n)) | ((n <= 2) & (STOP[m["last"]] == 0))
    boilerplate = np.zeros(len(n), bool)
    for x in BOILERPLATE.finditer(data):
        boilerplate[np.searchsorted(m["ls"], x.start(), "right") - 1] = True
    boilerplate &= n <= 40
    return (n > 0) & (symbols | shouting | capitals | navigation | boilerplate | m["dup"])


RESULT = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_failed_lines": "long", "lost_chars": "long", "base_failed": "boolean", "kept": "boolean", "clean_text": "string"}


def _clean(text_at: int, max_lost: float, with_text: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column(text_at)):
                m = line_measures(data, off)
                fails = failing_lines(m, data)
                by = lambda x, f=m["line_first"]: (c := sums(x))[f[1:]] - c[f[:-1]]
                words, chars = np.diff(m["first"]), by(m["chars"])
                repeat = repeated(m["hashes"], m["first"], 8)
                lost = by(np.where(fails, m["chars"], 0))
                base = (words < 20) | (100 * repeat > 30 * words)
                kept = ~base & (lost <= max_lost * chars)
                part = batch.slice(i, j - i)
                clean = pa.nulls(j - i, pa.string())
                if with_text:
                    texts = part.column(text_at).to_pylist()
                    for d in np.flatnonzero(by(fails.astype(np.int64))).tolist():
                        a, b = m["line_first"][d], m["line_first"][d + 1]
                        texts[d] = b"\n".join(data[m["ls"][x] : m["le"][x]].tobytes() for x in range(a, b) if not fails[x]).decode("utf-8", "replace")
                    clean = pa.array(texts, pa.string())
                out = [words, chars, by(m["symbols"]), by(m["dup"].astype(np.int64)), repeat, by(fails.astype(np.int64)), lost, base, kept]
                yield pa.record_batch([*part.columns, *map(pa.array, out), clean], names)

    return run


def clean_lines(docs: DataFrame, max_lost: float = 0.4, with_text: bool = True) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines, lost_chars (word
    characters of failed lines), base_failed, kept and clean_text (the text without failed lines; null unless asked).

    kept is false if the base rules fail the document (under 20 words, or over 30 % of them within repeated 8-word
    windows) or if its failed lines hold more than max_lost of its word characters. A null text has no words and is
    not kept. Ties cannot arise; repeated rows are treated alike, each on its own; an empty table gives no rows; very
    long texts and words are whole. Columns of docs stay, but those with the names above are replaced.
    """
    docs = docs.drop(*RESULT).withColumn("text", F.col("text").cast("string"))
    schema = with_columns(docs.schema, ", ".join(f"{k} {v}" for k, v in RESULT.items()))
    return docs.mapInArrow(_clean(docs.columns.index("text"), max_lost, with_text, [*docs.columns, *RESULT]), schema)
