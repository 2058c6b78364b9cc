"""Byte-pair merges against a recount of all pairs before each merge."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siltstone.operators import bpe, encode


def recounted(words, vocab_size, specials, least=1):
    tokens = [*specials, *sorted({c for w in words for c in w})]
    parts = {w: list(w) for w in words}
    out = []
    while len(tokens) < vocab_size:
        pairs = Counter()
        for w, n in words.items():
            for p in zip(parts[w], parts[w][1:]):
                pairs[p] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], tokens.index(p[0]), tokens.index(p[1])))
        if pairs[best] < least:
            break
        out.append(best)
        if "".join(best) not in tokens:
            tokens.append("".join(best))
        for x in parts.values():
            i = 0
            while i < len(x) - 1:
                if (x[i], x[i + 1]) == best:
                    x[i : i + 2] = ["".join(best)]
                i += 1
    return out


def test_merges_are_those_of_a_full_recount():
    for seed in range(12):
        rng = random.Random(seed)
        words = {"".join(rng.choices("abcé𝄞"[: 2 + seed % 4], k=rng.randint(1, 9))): rng.randint(1, 5) for _ in range(60)}
        for size, least in ((40, 1), (1000, 1), (1000, 4)):
            half = len(words) // 2
            column = pa.chunked_array([list(words)[:half], list(words)[half:]], pa.string())
            got = encode.learn_merges(column, np.array(list(words.values())), size, least, specials=("[UNK]",))
            assert got == recounted(words, size, ["[UNK]"], least)
    assert encode.learn_merges(pa.chunked_array([], pa.string()), np.zeros(0, np.int64), 50) == []


def test_rare_words_are_learnt_from_and_tokens_are_whole(spark):
    # 2,100 frequent words without "zq", then 9,000 rare ones that hold it.
    common = [f"{chr(97 + i % 20)}{i}" for i in range(2100)]
    docs = spark.createDataFrame([(i, " ".join(common)) for i in range(3)] + [(9, " ".join(f"zq{i}" for i in range(9000)))], "id long, text string")
    merges = encode.train_bpe(docs)
    assert ("z", "q") in merges
    got = {r.id: r.tokens for r in encode.bpe_encode(docs, merges).collect()}
    assert "".join(got[0]) == "".join(common) and len(merges) > 60


@pytest.mark.parametrize("seed, hot, segments, size, least", [(1, 1, 40, 60, 1), (2, 5, 9, 400, 1), (3, 256, 200_000, 400, 3), (4, 7, 30, 45, 1)])
def test_rounds_give_the_merges_of_a_full_recount(spark, monkeypatch, seed, hot, segments, size, least):
    rng = random.Random(seed)
    monkeypatch.setattr(bpe, "SEGMENTS", segments)
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 20)
    texts = [" ".join("".join(rng.choices("abcé𝄞"[: 2 + seed % 4], k=rng.randint(1, 8))) for _ in range(rng.randint(0, 12))) for _ in range(25)] + [None, "", "aaaaaaa " * 5]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    words = Counter(w for t in texts for w in encode.pre_tokens(t))
    assert encode.train_bpe(docs, size, least, specials=("[UNK]", "ab"), hot=hot) == recounted(words, size, ["[UNK]", "ab"], least)


def test_pieces_hold_all_places_of_hot_pairs():
    lengths, symbols = np.array([4, 2, 3]), np.array([1, 2, 1, 2, 2, 1, 1, 2, 3])
    starts, ends = bpe._cut(lengths, symbols, np.array([1 * bpe.WIDE + 2]))
    assert [symbols[s:e].tolist() for s, e in zip(starts, ends)] == [[1, 2], [1, 2], [1, 2]]
    starts, ends = bpe._cut(lengths, symbols, np.array([1 * bpe.WIDE + 2, 2 * bpe.WIDE + 1]))
    assert [symbols[s:e].tolist() for s, e in zip(starts, ends)] == [[1, 2, 1, 2], [2, 1], [1, 2]]


def test_pre_tokens_letter_by_letter():
    import unicodedata

    def plain(x):
        out, word = [], ""
        for ch in unicodedata.normalize("NFKC", x or ""):
            if ch.isspace() or unicodedata.category(ch)[0] in "PS":
                out += [word] if word else []
                out += [] if ch.isspace() else [ch]
                word = ""
            else:
                word += ch
        return out + ([word] if word else [])

    rng = random.Random(3)
    every = "ab1_ -\t\n\x0b\x1c\x85\x00\x7f'\"$+€«é́ﬁ½①一😀 ​　¨"
    for x in [None, "", *("".join(rng.choices(every, k=rng.randint(1, 30))) for _ in range(3000)), *(chr(c) + "a" + chr(c) for c in range(0x3000))]:
        assert encode.pre_tokens(x) == plain(x)


def test_no_words(spark):
    assert encode.train_bpe(spark.createDataFrame([], "text string")) == []
    assert encode.train_bpe(spark.createDataFrame([(None,), ("a b",)], "text string")) == []
