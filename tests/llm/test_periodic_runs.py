"""Periodic runs against trying every period at every place."""

import random

import numpy as np
import pytest

from siltstone.llm import periodic_runs


def brute(w, times=4, least=6):
    """{(start, end): smallest period} of the stretches that keep a period as far as they can."""
    n, got = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                got.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, q, e) for (s, e), q in got.items())


def collapsed(w, runs):
    gone = {i for s, q, e in runs for i in range(s + q, e)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts_of(rng):
    for _ in range(rng.randint(1, 5)):
        k, n = rng.randint(1, 4), rng.randint(0, 45)
        t = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
        yield t


@pytest.mark.parametrize("times, least", [(4, 6), (2, 2), (3, 5)])
def test_many_texts_at_once(times, least):
    rng = random.Random(times)
    for _ in range(700):
        texts = list(texts_of(rng))
        start, end, period = periodic_runs.runs_of(np.array(sum(texts, []), np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts]), times, least)
        want, at = [], 0
        for t in texts:
            want += [(s + at, q, e + at) for s, q, e in brute(t, times, least)]
            at += len(t)
        assert list(zip(start.tolist(), period.tolist(), end.tolist(), strict=True)) == want


def test_a_power_of_a_period_is_one_run():
    start, end, period = periodic_runs.runs_of(np.array([1, 2] * 50_000), np.zeros(100_000, np.int64))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [100_000], [2])


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "WORDS", 60)
    rng = random.Random(11)
    texts = ["", None, " \n", "one", "a " * 5, "a " * 6, "a b\tc\n" * 4, "x " + "é è " * 9 + "y y y y y y", "long " * 30_000]
    texts += [" ".join(f"w{x}" for x in t) for _ in range(60) for t in texts_of(rng)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "b b b b b b b", 2), (5, "a " * 6, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, collapsed_ int").repartition(3)
    got = periodic_runs.find_runs(docs, keep=("doc_id", "collapsed_")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "b b b b b b b" if r.doc_id is None else texts[r.doc_id]
        w = (text or "").split()
        runs = brute(w) if len(w) < 1000 else [(0, 1, len(w))]
        assert r.n_words == len(w) and r.collapsed == collapsed(w, runs)
        assert [(x.start, x.period, x.start + x.length) for x in r.runs] == runs
    assert periodic_runs.find_runs(docs.limit(0)).collect() == []


def test_only_ascii_white_space_separates(spark):
    docs = spark.createDataFrame([(1, "a a a a a a a a a a a a"), (2, "a\x1ca " * 6)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.find_runs(docs).collect()}
    assert got[1].n_words == 6 and got[1].collapsed == "a a" and got[2].collapsed == "a\x1ca"


def test_planting_by_plain_words(spark):
    from zlib import crc32

    from siltstone.llm import queries

    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(300)] + [(None, "a b")], "doc_id long, text string")
    planted = 0
    for r in queries.planted_runs(docs).collect():
        w = [f"w{j}" for j in range(r.doc_id % 37)] if r.doc_id is not None else ["a", "b"]
        h = crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        assert r.text.split() == w
    assert planted > 10
