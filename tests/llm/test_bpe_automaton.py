"""The tokenization automaton against merging word by word, and against the library whose file it reads."""

import hashlib
import random

import numpy as np
import pytest

from siltstone.llm import bpe_automaton as bpe

public = pytest.importorskip("public_tokenizers")
WORD_FILE = public.path("word_bpe_49k.json")


def merged(word, merges):
    """Each merge in its order, at all its places from the left."""
    out = [int(c) for c in word]
    for u, v, w in merges:
        at, new = 0, []
        while at < len(out):
            if out[at : at + 2] == [u, v]:
                new.append(w)
                at += 2
            else:
                new.append(out[at])
                at += 1
        out = new
    return out


@pytest.mark.parametrize("seed", range(30))
def test_merges_in_order_on_random_vocabularies(seed):
    rng = random.Random(seed)
    letters = rng.randint(1, 3)
    labels, merges = [str(i) for i in range(letters)], []
    for _ in range(rng.randint(0, 40)):
        u, v = rng.randrange(len(labels)), rng.randrange(len(labels))
        if labels[u] + labels[v] not in labels and len(labels[u] + labels[v]) < 12:
            merges.append((u, v, len(labels)))
            labels.append(labels[u] + labels[v])
    a = bpe.Automaton(*bpe.compile_merges(list(range(letters)), merges, len(labels)), labels, "", {})
    for _ in range(150):
        word = "".join(str(rng.randrange(letters)) for _ in range(rng.randint(0, 24)))
        assert a.encode(word) == merged(word, merges)


def test_order_and_results_of_merges_are_checked():
    with pytest.raises(ValueError, match="parts"):
        bpe.compile_merges([0, 1], [(0, 2, 3), (0, 1, 2)], 4)
    with pytest.raises(ValueError, match="parts"):
        bpe.compile_merges([0, 1, 2], [(0, 1, 3), (1, 2, 4), (3, 2, 5), (0, 4, 5)], 6)


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(WORD_FILE)
    t.no_truncation()
    t.no_padding()
    return t


def test_as_the_library_on_awkward_texts(spark):
    rng = random.Random(7)
    bits = ["the", "a" * 9, "ing", " ", "'s", "'LL", "!!'s", "<|endoftext|>", "<|startoftext|>x", "İ", "ΣΑΣ", "É", "é", "\x1c", "\x85", "　", "9", "½", "😀", "日本", "\n\n", "\t", "ﬁ", "1234", "don't", "Å"]
    texts = ["", None, " ", "\x00", "a" * 50_000, "word " * 3000, *["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, None, "x"), (None, "null id", None)], "doc_id long, text string, n_tokens_ string").repartition(3)
    got = bpe.encode_documents(docs, WORD_FILE, with_tokens=True)
    assert got.count() == len(texts) + 2
    t = library()
    for r in got.collect():
        text = "null id" if r.doc_id is None else texts[r.doc_id] or ""
        ids = t.encode(text, add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.decoded, r.n_tokens) == (ids, decoded, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_as_the_library_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t = library()
    got = rows_of(bpe.encode_documents(docs, WORD_FILE))
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_memory_of_words_does_not_change_results(monkeypatch):
    a = bpe.load(WORD_FILE)
    texts = ["some words again and some words", "again words! Words? some"]
    whole = [bpe.Encoder(a).text(t) for t in texts]
    monkeypatch.setattr(bpe, "REMEMBERED", 1)
    short = bpe.Encoder(a)
    assert [short.text(t) for t in texts] == whole


def test_empty_table_and_other_files(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(docs, WORD_FILE).collect() == []
    with pytest.raises(ValueError, match="only byte-level"):
        bpe.load(public.path("byte_bpe_50k.json"))
