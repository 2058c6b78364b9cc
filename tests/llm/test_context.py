"""Language-model scores: contexts across words, the same model whatever the partitioning, and a plain version of it."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from siltstone.llm import context_mixing as cm
from siltstone.llm import lm_score
from siltstone.llm.wordarrays import BY_SPACE, span_hashes, spans


def test_word_order_counts(spark):
    rng = random.Random(3)
    chain = [f"{rng.choice('abcdefgh')}{i}{rng.choice('xyz')}" for i in range(40)]
    rows = [(i, " ".join((chain * 2)[(at := rng.randrange(40)) : at + 30])) for i in range(300)]
    mixed = lambda: " ".join(rng.sample(chain[:30], 30))  # noqa: E731  another order each time
    docs = spark.createDataFrame(rows + [(1000 + i, " ".join(chain[:30]) if i < 50 else mixed()) for i in range(100)], "doc_id long, text string")
    got = [r for r in lm_score.train_and_score(docs, parts=2, held=1).collect() if r.held_out and r.doc_id >= 1000]
    ordered, shuffled = ([r for r in got if (r.doc_id < 1050) == side] for side in (True, False))
    assert ordered and shuffled
    assert {round(r.base_score, 5) for r in ordered} == {round(r.base_score, 5) for r in shuffled}
    assert min(r.score for r in ordered) > max(r.score for r in shuffled)


def some_texts(seed=5):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdé" for b in ("", "x", "yz", "zzzz")]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)) + rng.choices(["Rare" + str(rng.randint(0, 999)), words[0]], k=2))) for i in range(60)]
    return rows + [(70, None), (71, ""), (None, "ax b"), (5, rows[5][1])]


def test_partitions_change_nothing(spark):
    docs = spark.createDataFrame(some_texts(), "doc_id long, text string")
    seen = []
    for n, parts in (("4", 3), ("37", 11)):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 9), round(r.score, 9), round(r.bits_per_byte, 9)) for r in lm_score.train_and_score(docs.repartition(parts)).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def plain_scores(rows, top=lm_score.TOP):
    """The same by loops: words of a text, decisions of a word, counts in dictionaries."""
    word_hash = lambda w: int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    texts = [(zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2, [w.encode() for w in (t or "").lower().split()]) for i, t in rows]
    count = Counter(word_hash(w) for train, ws in texts if train for w in ws)
    code = sorted(h for h, c in count.items() if c > 1)
    k, ends = len(code), sum(train for train, _ in texts)
    tree = cm.Tree(np.array([*(count[h] for h in code), ends, sum(c for c in count.values() if c == 1) + 1]))
    number, bits = {h: i for i, h in enumerate(code)}, cm.bits_for(sum(count.values()))
    m32 = 0xFFFFFFFF

    def mixed(x):
        x = ((x ^ (x >> 16)) * 0x7FEB352D) & m32
        x = ((x ^ (x >> 15)) * 0x846CA68B) & m32
        return x ^ (x >> 16)

    def place(h, node, n):
        return (((h ^ (node * 0x9E3779B1 & m32)) * 0x85EBCA6B) & m32) >> (32 - n)

    def decisions(words):
        ids = [m32] * 3
        for w in [*words, None]:
            h = None if w is None else word_hash(w)
            t = k if w is None else number.get(h, k + 2 + h % lm_score.OTHERS)
            one = mixed((ids[-1] + 1) & m32)
            two = mixed((one * 0x9E3779B1 + ids[-2] + 2) & m32)
            own = [one, two, mixed((two * 0x9E3779B1 + ids[-3] + 3) & m32)]
            ids.append(t)
            now = min(t, k + 1)
            while now != tree.root:
                node, bit = int(tree.parent[now]), int(tree.side[now])
                yield 0, int(tree.level[node]), [(o, place(x, node, bits)) for o, x in enumerate(own)], bit
                now = node
            if t > k:
                seen, total = [0, 0, 0], 0
                for d, b in enumerate(w + b" "):
                    one, two = seen[-1], seen[-1] | seen[-2] << 8
                    own = [mixed(one + 11), mixed(two + (1 << 25)), mixed((two | seen[-3] << 16) + (1 << 26)), mixed((total >> 32) ^ (total & m32))]
                    total = (total + int(cm._BYTE[b]) * int(cm._POW[d])) & (1 << 64) - 1
                    seen.append(b)
                    for j in range(8):
                        yield 1, None, [(3 + o, place(x, 1 << j | b >> (8 - j), cm.SPELL_BITS)) for o, x in enumerate(own)], b >> (7 - j) & 1

    slots = Counter((s, bit) for train, ws in texts if train for _, _, own, bit in decisions(ws) for s in own)

    def cell(kind, level, own, out=None):
        states = [] if level is None else [level]
        for s in own:
            n = [slots[s, 0], slots[s, 1]]
            if out is not None:
                n[out] -= 1
            states.append(int(cm.state_of(np.array([n[0]]), np.array([n[1]]))[0]))
        return sum(x * cm.STATES ** (3 - i) for i, x in enumerate(states))

    seen = np.zeros((2, cm.CELLS, 2), np.int64)
    for train, ws in texts:
        for kind, level, own, bit in decisions(ws) if train else ():
            seen[kind, cell(kind, level, own, bit), bit] += 1
    p = [cm.learn(x) for x in seen]
    return [sum(math.log10(p[kind][c] if bit else 1 - p[kind][c]) for kind, level, own, bit in decisions(ws) for c in [cell(kind, level, own)]) for _, ws in texts]


def test_scores_against_plain_loops(spark):
    rows = some_texts(6)
    want = sorted((str(i), round(s, 6)) for (i, _), s in zip(rows, plain_scores(rows), strict=True))
    got = lm_score.train_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == want


def model(seed=0):
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 40, 30)
    tree, bits = cm.Tree(counts), 16
    ids = rng.integers(0, 30, 4000).astype(np.int32)
    off, none = np.arange(0, 4001, 40), (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    total = [np.zeros(2 * n, np.uint32) for n in cm.sizes(bits)]
    cm.count_into(total, tree, ids, off, *none, bits)
    tables, seen = [cm.packed(x.reshape(-1, 2)) for x in total], np.zeros((2, cm.CELLS, 2), np.uint32)
    cm.histogram(seen, cm.left_out(tables), tree, ids, off, *none, bits)
    logs = np.stack([np.log10(np.stack([1 - p, p], axis=1)).ravel() for p in map(cm.learn, seen)])
    return tree, tables, logs, bits


def test_probabilities_of_the_next_token_add_up():
    tree, tables, logs, bits = model()
    none = (np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64))
    ids = np.array([[3, 7, t] for t in range(30)]).ravel()
    whole = cm.text_scores(logs, cm.as_seen(tables), tree, ids, np.arange(0, 91, 3), *none, bits)
    begin = cm.text_scores(logs, cm.as_seen(tables), tree, np.array([3, 7]), np.array([0, 2]), *none, bits)
    assert abs((10 ** (whole - begin)).sum() - 1) < 1e-9


def test_the_code_is_a_prefix_code_and_short():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 0])
    tree, lengths = cm.Tree(counts), []
    for leaf in range(len(counts)):
        n, now = 0, leaf
        while now != tree.root:
            n, now = n + 1, tree.parent[now]
        lengths.append(n)
    assert sum(2.0**-n for n in lengths) == 1
    share = counts[counts > 0] / counts.sum()
    assert (counts * lengths).sum() / counts.sum() < -(share * np.log2(share)).sum() + 1


def test_long_words_are_not_cut_and_slices_change_nothing(monkeypatch):
    def beginnings(word):
        return cm.spelt_bytes(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))[2][3]

    # The first byte still tells the beginnings apart at every depth.
    one, other = beginnings("a" + "x" * 200), beginnings("b" + "x" * 200)
    assert (one[1:] != other[1:]).all() and len(set(one.tolist())) == 202
    tree, tables, logs, bits = model()
    ids, off = np.arange(90) % 31, np.array([0, 0, 40, 90])
    words, woff, owner = np.frombuffer(b"abcde", np.uint8), np.array([0, 2, 5]), np.array([1, 2])
    whole = cm.text_scores(logs, cm.as_seen(tables), tree, ids, off, words, woff, owner, bits)
    monkeypatch.setattr(cm, "SLICE", 7)
    assert np.allclose(whole, cm.text_scores(logs, cm.as_seen(tables), tree, ids, off, words, woff, owner, bits)) and whole[0] == 0


def test_frequent_tokens_are_chosen_within_the_bound(spark):
    counts = [1, 1, 2, 2, 2, 3, 7, 7, 50, 10**7, 10**7]
    vocab = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "h long, c long")
    for top, most in ((100, 9), (6, 6), (2, 2), (1, 0)):
        n = sum(c >= lm_score._least_of(vocab, top) for c in counts)
        assert n <= top and n <= most and (top < 9 or n == 9)
    assert lm_score._least_of(vocab.where("c = 1"), 10) > 1


def test_spans_of_words_are_as_counted():
    data = np.frombuffer(b" Ab  cd\n", np.uint8)
    s, e, first = spans(data, np.array([0, len(data)]), BY_SPACE)
    raw, off = lm_score.gather(data, s, e)
    assert bytes(raw) == b"abcd" and off.tolist() == [0, 2, 4] and first.tolist() == [0, 2]
