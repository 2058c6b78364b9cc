"""Words of many texts at once as numpy arrays: spans, 64-bit hashes and hashes of word runs."""

from __future__ import annotations

import numpy as np

U = np.uint64


def _mixed(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd or even 64-bit numbers by a rule (splitmix)."""
    x = (np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: 1 for the bytes of words between ASCII white space.
BY_SPACE = np.ones(256, np.uint8)
BY_SPACE[[9, 10, 11, 12, 13, 32]] = 0
#: 1 for digits, ASCII letters and every byte from 0x80 on.
BY_LETTER = np.zeros(256, np.uint8)
BY_LETTER[48:58] = BY_LETTER[65:91] = BY_LETTER[97:123] = BY_LETTER[128:] = 1

_BYTE = _mixed(256, 77)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_P = U(0x5851F42D4C957F2D)
_P_INV = U(pow(int(_P), -1, 1 << 64))
_RUN = _mixed(64, 4242) | U(1)
BLOCK = 1 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_P, BLOCK + 1), _powers(_P_INV, BLOCK + 1)


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = BY_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and one more) of the words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data].view(bool)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at] = inside[at]
    at = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and do not overlap. lower: A-Z count as a-z."""
    table, n, i = _BYTE_LOWER if lower else _BYTE, len(starts), 0
    out = np.empty(n, U)
    while i < n:
        j = int(np.searchsorted(ends, starts[i] + BLOCK, "right"))
        if j <= i:  # one span longer than a block
            total, at, scale = U(0), int(starts[i]), U(1)
            with np.errstate(over="ignore"):
                while at < ends[i]:
                    part = table[data[at : min(at + BLOCK, int(ends[i]))]]
                    total += scale * np.sum(part * _POW[: len(part)], dtype=U)
                    scale *= _POW[BLOCK]
                    at += BLOCK
            out[i] = total
            i += 1
            continue
        lo, hi = int(starts[i]), int(ends[j - 1])
        total = np.empty(hi - lo + 1, U)
        total[0] = 0
        np.cumsum(table[data[lo:hi]] * _POW[: hi - lo], out=total[1:])
        s = starts[i:j] - lo
        out[i:j] = (total[ends[i:j] - lo] - total[s]) * _INV[s]
        i = j
    return mix(out ^ ((ends - starts).astype(U) * U(0x9E3779B97F4A7C15)))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k words in a row, whatever text they belong to."""
    if len(words) < k:
        return np.zeros(0, U)
    n = len(words) - k + 1
    total = words[:n] * _RUN[0]
    for i in range(1, k):
        total += words[i : i + n] * _RUN[i]
    return mix(total)


def short_hash(words: np.ndarray) -> np.ndarray:
    """The hash of a text's few words as one run; differs from a run of another length."""
    with np.errstate(over="ignore"):
        return mix(np.array([np.sum(words * _RUN[: len(words)], dtype=U) + U(len(words)) * U(0xD6E8FEB86659FD93)], U))


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word runs of each text; of fewer words, the whole as one; of none, empty."""
    runs, out = run_hashes(words, k), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(runs[a : b - k + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        else:
            x = short_hash(words[a:b]) if b > a else np.zeros(0, U)
        out.append(x)
    return out
