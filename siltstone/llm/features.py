"""Numbers that describe a text's style; both classifiers read them."""

from __future__ import annotations

import numpy as np

from siltstone.llm.quality_rules import LOWER, UPPER, line_measures, repeated, sums

STYLE = ("log_words", "symbols", "upper", "shouts", "pipes", "digits", "dup_lines", "repeats", "distinct", "word_chars", "line_words", "stops", "doubled", "wide")
DIGIT = np.zeros(256, np.uint8)
DIGIT[48:58] = 1
FULL_STOP = np.zeros(256, np.uint8)
FULL_STOP[[33, 46, 63]] = 1
HIGH = np.zeros(256, np.uint8)
HIGH[192:] = 1


def style(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(a row of STYLE for each text, line_measures' arrays). An empty text has a row of zeros."""
    m = line_measures(data, off)
    lf = m["line_first"]
    by_line = lambda x: (c := sums(x))[lf[1:]] - c[lf[:-1]]
    by_byte = lambda flags: (c := sums(flags[data]))[off[1:]] - c[off[:-1]]
    first, h = m["first"], m["hashes"]
    words = np.diff(first)
    n, chars = np.maximum(words, 1), np.maximum(by_line(m["chars"]), 1)
    distinct, same = np.zeros(len(words)), np.zeros(len(words))
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a > 1:
            x = np.sort(h[a:b])
            distinct[d] = 1 + np.count_nonzero(x[1:] != x[:-1])
            same[d] = np.count_nonzero(h[a + 1 : b] == h[a : b - 1])
        else:
            distinct[d] = b - a
    upper, lower = by_byte(UPPER), by_byte(LOWER)
    out = np.stack([
        np.log1p(words) / 10, by_line(m["symbols"]) / chars, upper / np.maximum(upper + lower, 1), np.minimum(by_line(m["shouts"]) / n, 2), np.minimum(by_line(m["pipes"]) / n, 1),
        by_byte(DIGIT) / chars, by_line(m["dup"].astype(np.int64)) / np.maximum(by_line((m["n_words"] > 0).astype(np.int64)), 1), repeated(h, first, 8) / n,
        distinct / n, np.minimum(chars / n, 40) / 10, np.log1p(words / np.maximum(np.diff(lf), 1)) / 5, np.minimum(by_byte(FULL_STOP) / n, 2), same / n, by_byte(HIGH) / chars,
    ], axis=1)
    out[words == 0] = 0
    return out, m
