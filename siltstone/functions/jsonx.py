"""Strict JSON where Spark's own parsers are lenient, and shapes of answers."""

from __future__ import annotations

import json
import random
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import strip_fences

#: Phrases and their alternatives, the first of which is the phrase itself.
PHRASES = {
    r"\bi was driving\b": ["I was driving", "I was heading", "I was travelling", "I was on my way", "I was navigating"],
    r"\bthe other driver\b": ["the other driver", "the second vehicle", "the individual driving the other car", "the oncoming driver"],
    r"\bthere is a\b": ["there is a", "I noticed a", "you can see a", "it left a", "it resulted in a"],
    r"\bscratch on the\b": ["scratch on the", "scrape along the", "mark on the"],
    r"\bdent on the\b": ["dent on the", "damage to the", "impact depression on the", "crush on the"],
    r"\bi didn't see\b": ["I didn't see", "I failed to notice", "I could not spot", "it slipped my attention", "I missed seeing"],
    r"\bi tried to\b": ["I tried to", "I attempted to", "I made an effort to", "I did my best to"],
    r"\bit was a\b": ["it was a", "it happened to be a", "the situation involved a"],
}
APPLY_SHARE = 0.6


def first_object(raw: str) -> str | None:
    """The text as a JSON object, or else what is from its first { to its last }; as JSON again, or None."""
    at, end = raw.find("{"), raw.rfind("}")
    for part in (raw, raw[at : end + 1] if -1 < at < end else None):
        if part is not None:
            try:
                value = json.loads(part)
            except ValueError:
                continue
            if isinstance(value, dict):
                return json.dumps(value, ensure_ascii=False)
    return None


@F.pandas_udf(T.StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: first_object(x or ""))


def extract_json_object(c: Column | str) -> Column:
    return _first_object(strip_fences(c))


def fragments(raw: str) -> list[str]:
    """The objects of concatenated JSON values; what does not parse is skipped up to the next [ or {; a list's objects
    count singly, and those of an object's list `annotations` or `claims` in its stead."""
    decode, out, at = json.JSONDecoder().raw_decode, [], 0
    while m := re.compile(r"[\[{]").search(raw, at):
        try:
            value, at = decode(raw, m.start())
        except ValueError:
            at = m.start() + 1
            continue
        stack = value if isinstance(value, list) else [value]
        for x in stack:
            if isinstance(x, dict):
                inner = next((x[k] for k in ("annotations", "claims") if isinstance(x.get(k), list)), [x])
                out += [json.dumps(y, ensure_ascii=False) for y in inner if isinstance(y, dict)]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_fragments(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: fragments(x or ""))


def strict_fragments(raw: str) -> tuple[list[str] | None, str | None]:
    """(objects, None) of a text that is a JSON value, or JSON values with other text before and between them; of an
    object with a list `annotations`, that list's. (None, reason) where nothing is there, a value breaks off, or anything
    but objects is found. Nothing is skipped for not parsing; fragments() does that."""
    text, values, at = raw.strip(), [], 0
    if not text:
        return None, "empty"
    try:
        values.append(json.loads(text))
        alone = True
    except ValueError:
        alone = False
        while m := re.compile(r"[\[{]").search(text, at):
            try:
                value, at = json.JSONDecoder().raw_decode(text, m.start())
            except ValueError:
                return None, f"no JSON value at {m.start()}"
            values.append(value)
    out: list[str] = []
    for value in values:
        if isinstance(value, dict):
            value = value["annotations"] if isinstance(value.get("annotations"), list) else [value]
        if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
            return None, "not all values are objects"
        out += [json.dumps(x, ensure_ascii=False) for x in value]
    return (out, None) if out or alone else (None, "no objects")


@F.pandas_udf(T.StructType([T.StructField("objects", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())]))
def parse_strictly(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([strict_fragments(x or "") for x in texts], columns=["objects", "reason"])


def vary(text: str, key: str, seed: int = 42) -> str:
    """Each phrase, with a chance of APPLY_SHARE a text, by an alternative drawn for each place; a capital stays."""
    for i, (pattern, options) in enumerate(PHRASES.items()):
        rng = random.Random(f"{seed}:{key}:{i}")
        if rng.random() >= APPLY_SHARE:
            continue

        def swap(m: re.Match, rng=rng, options=options) -> str:
            new, old = rng.choice(options), m.group(0)
            return new[0].upper() + new[1:] if old[0].isupper() and old[1:2].islower() else new

        text = re.sub(pattern, swap, text, flags=re.IGNORECASE)
    return text


@F.pandas_udf(T.StringType())
def augment_text(texts: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series([vary(t or "", str(k)) for t, k in zip(texts, keys, strict=True)])


def flat_answer(c: Column | str) -> Column:
    """A flat object with a probability and then a verdict, or the slice from the first { to the last }."""
    raw = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    own = F.regexp_extract(raw, r'(?s)\{[^{}]*"probability_true"[^{}]*"verdict"[^{}]*\}', 0)
    whole = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.nullif(F.when(own != "", own).otherwise(whole), F.lit(""))


def cascade(valid: Column, verdict: Column, p: Column) -> Column:
    """(verdict, probability_true, source): the verdict of a valid answer, or else the probability's, or else not_true."""
    return (
        F.when(valid, F.struct(verdict.alias("verdict"), p.alias("probability_true"), F.lit("verdict").alias("source")))
        .when(p.isNotNull(), F.struct(F.when(p >= 0.5, "true").otherwise("not_true").alias("verdict"), p.alias("probability_true"), F.lit("probability_fallback").alias("source")))
        .otherwise(F.struct(F.lit("not_true").alias("verdict"), F.lit(0.5).alias("probability_true"), F.lit("invalid_default").alias("source")))
    )
