"""Vocabularies, padded ids and array arithmetic for models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.bpe import apply_merges, bpe_encode, learn_merges, pre_tokens, train_bpe  # noqa: F401
from siltstone.sources.tables import numbered

#: Characters that the word tokenizer takes for spaces.
PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
OOV = 1
CLS, SEP, PAD = 2, 3, 0

def words(c: Column | str) -> Column:
    """Lower-case words between punctuation and spaces."""
    plain = F.translate(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), PUNCTUATION, " " * len(PUNCTUATION))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def word_vocab(docs: DataFrame, most: int | None = None) -> DataFrame:
    """docs (id, text) -> (word, n, index): by frequency, equal ones by first appearance (id, then place), from 2 on;
    1 is for unknown words. most: indexes under it only."""
    seen = docs.select("id", F.posexplode(words("text")).alias("place", "word"))
    per = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "place")).alias("first"))
    per = per.select("word", "n", (-F.col("n")).alias("_k"), F.col("first.id").alias("_i"), F.col("first.place").alias("_p"))
    out = numbered(per, "_k", "_i", "_p", name="index", start=2).drop("_k", "_i", "_p")
    return out.where(F.col("index") < most) if most else out


#: Words of a vocabulary that encode_pad sends to every task; a larger one is joined.
VOCAB_ROWS = 200_000


def encode_pad(docs: DataFrame, vocab: DataFrame, length: int = 400) -> DataFrame:
    """docs (id, text) -> (id, ids): the first `length` words' indexes, zeros after them. A vocabulary of VOCAB_ROWS words
    or fewer is looked up where the texts are, without a shuffle."""
    first = docs.select("id", F.slice(words("text"), 1, length).alias("w"))
    known = vocab.select("word", F.col("index").cast("int").alias("index"))
    few = known.limit(VOCAB_ROWS + 1).toArrow()
    if few.num_rows <= VOCAB_ROWS:
        names, index = few.column("word").combine_chunks(), few.column("index").combine_chunks().to_numpy()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w = batch.column(1)
                at = pc.fill_null(pc.index_in(w.flatten(), value_set=names), -1).to_numpy()
                n = np.diff(w.offsets.to_numpy())
                out = np.full(batch.num_rows * length, PAD, np.int32)
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                out[row * length + place] = np.where(at >= 0, np.append(index, OOV)[at], OOV)
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * length), pa.array(out))], ["id", "ids"])

        return first.mapInArrow(run, f"id {first.schema['id'].dataType.simpleString()}, ids array<int>")
    rows = first.select("id", F.posexplode("w").alias("place", "word")).join(known, "word", "left")
    ids = rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("index", F.lit(OOV)).alias("i")))), lambda x: x["i"]).alias("ids"))
    full = F.coalesce("ids", F.array().cast("array<int>"))
    return first.select("id").join(ids, "id", "left").select("id", F.concat(full, F.array_repeat(F.lit(PAD), F.lit(length) - F.size(full))).alias("ids"))


def truncated_lengths(la: Column, lb: Column, budget: Column | int) -> tuple[Column, Column]:
    """What is left of two lengths when the longer one (of equals the first) gives way until both fit."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    a = F.when(la + lb <= b, la).otherwise(F.least(la, F.greatest(b - lb, F.floor(b / 2)))).cast("int")
    return a, F.when(la + lb <= b, lb).otherwise(F.least(lb, b - a)).cast("int")


def pair_encode(a: Column, b: Column, length: int = 256) -> Column:
    """(input_ids, attention_mask, token_type_ids) of [CLS] a [SEP] b [SEP], padded to length."""
    la, lb = truncated_lengths(F.size(a), F.size(b), length - 3)
    ids = F.concat(F.array(F.lit(CLS)), F.slice(a, F.lit(1), la), F.array(F.lit(SEP)), F.slice(b, F.lit(1), lb), F.array(F.lit(SEP)))
    used, pad = la + lb + 3, F.lit(length) - (la + lb + 3)
    zero = F.array_repeat(F.lit(0), pad)
    return F.struct(
        F.concat(ids, F.array_repeat(F.lit(PAD), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), used), zero).alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(0), la + 2), F.array_repeat(F.lit(1), lb + 1), zero).alias("token_type_ids"),
    )


def sft_labels(prompt: Column, answer: Column, length: int) -> Column:
    """Ids of prompt and answer, cut to length, with -100 for the prompt's."""
    return F.transform(F.slice(F.concat(prompt, answer), 1, length), lambda x, i: F.when(i < F.size(prompt), F.lit(-100)).otherwise(x))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors (an array of arrays) where the mask is 1; zeros where it is nowhere."""
    width = F.size(F.element_at(vectors, 1))
    n = F.greatest(F.aggregate(mask, F.lit(0), lambda s, x: s + x), F.lit(1))
    pick = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    total = F.aggregate(pick, F.array_repeat(F.lit(0.0), width), lambda s, x: F.zip_with(s, x["v"], lambda p, q: p + q.cast("double")))
    return F.transform(total, lambda x: x / n)


def segment_mask(attention: Column, types: Column, special: Column, segment: int) -> Column:
    """1 for a segment's own tokens, special ones apart."""
    zipped = F.arrays_zip(attention.alias("a"), types.alias("t"), special.alias("s"))
    return F.transform(zipped, lambda x: F.when((x["a"] == 1) & (x["t"] == segment) & (x["s"] == 0), 1).otherwise(0))


def comparison(p: Column, a: Column, b: Column) -> Column:
    """[p, a, b, |a - b|, a * b], one after another."""
    return F.concat(p, a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def argmax(values: Column) -> Column:
    """The place of the largest value, from 0; the first of equals."""
    return F.array_position(values, F.array_max(values)) - 1
