"""Importance resampling against counting features one by one."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from siltstone.llm import importance_resampling as resampling


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(f):
    return crc32(f.encode()) % 10_000


def plain(rows, targets):
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = Counter(bucket(f) for x in targets for f in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for i, text in rows:
        w, f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


def got(spark, rows, targets, parts=3):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, weight string").repartition(parts)
    out = resampling.resample(docs, spark.createDataFrame([(t,) for t in targets], "text string"))
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect())


@pytest.fixture
def rows():
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "The", "of", "é", "naïve", "3", "x", "it's", "一二", "---", f"r{rng.randrange(60)}"])
    out = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 60])))) for i in range(150)]
    return [*out, (3, out[3][1]), (200, None), (201, ""), (None, "word " * 25), (None, "other " * 25), (202, "x" * 100_000), (203, "y z " * 20_000)]


@pytest.mark.parametrize("nodes, words", [(1_500_000, 300_000), (5, 30)])
def test_as_counted_one_by_one(spark, rows, monkeypatch, nodes, words):
    monkeypatch.setattr(resampling, "NODES", nodes)
    monkeypatch.setattr(resampling, "WORDS", words)
    targets = ["the of the of x", None, "", "é naïve 3", "the of r7 r8"]
    want = plain(rows, targets)
    assert got(spark, rows, targets) == want
    assert got(spark, rows, targets, 7) == want


def test_empty_tables(spark, rows):
    assert not got(spark, [], ["the of"])
    assert got(spark, rows[:40], []) == plain(rows[:40], [])


def test_tries_are_emptied_without_a_trace():
    import numpy as np

    words, sizes = [b"a", b"b", b"a", b"b", b"c"], np.array([3, 0, 2])
    whole, parts = resampling.Trie(), np.zeros(resampling.BUCKETS, np.int64)
    whole.count(words, sizes)
    for w, s in ((words[:3], [3]), (words[3:], [0, 2])):
        t = resampling.Trie()
        t.count(w, np.array(s))
        parts += t.totals()
    assert (whole.totals() == parts).all() and parts.sum() == 5 + 3
