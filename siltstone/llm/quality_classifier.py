"""Quality classifier by Bradley-Terry ranking: P(a is better than b) = sigmoid(score(a) - score(b)) with a linear score,
learnt by logistic loss on feature differences of preference pairs, then cut at a quantile of the scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import modest_batches, settle, text_chunks
from siltstone.llm.features import STYLE, style

#: At most so many labelled rows are fitted on, those of the smallest md5 of doc_id.
FIT_ROWS = 20_000
PAIRS = 200_000


def fold(doc_id, parts: int):
    """crc32 of doc_id as text modulo parts; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def expanded(x: np.ndarray) -> np.ndarray:
    """Features, their square roots and squares: the score stays linear in them."""
    return np.concatenate([x, np.sqrt(x), x * x], axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in text_chunks(batch.column(1)):
            x, _ = style(data, off)
            yield pa.record_batch([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["doc_id", "x"])


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, most: int) -> DataFrame:
    """Labelled rows outside the held-out fold, one for each doc_id, at most `most`: (doc_id, text, label). Of several
    labels of an id the largest counts, of several texts the one with the smallest hash; null ids, labels and texts are
    not fitted on. Only hashes of an id's texts meet, however many rows it has."""
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).where((fold(F.col("doc_id"), parts) != 0) & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    marks = marks.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(most)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").withColumn("text_key", F.xxhash64("text")).join(F.broadcast(marks), "doc_id")
    first = own.groupBy("doc_id").agg(F.min("text_key").alias("text_key"))
    return own.join(F.broadcast(first), ["doc_id", "text_key"]).groupBy("doc_id", "label").agg(F.first("text").alias("text")).select("doc_id", "text", "label")


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = 1e-4, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights by Newton's method on random preference pairs (one text of label 1, one of label 0)."""
    x = expanded(x)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"w": np.zeros(x.shape[1]), "centre": centre, "scale": scale, "cut": np.array(0.0), "slope": np.array(1.0)}
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / pairs + l2 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + (l2 + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-4:
            break
    s = z @ w
    # The share of label 0 among the fitted rows gives the quantile at which scores are cut.
    cut = np.quantile(s, np.mean(y == 0))
    return {"w": w, "centre": centre, "scale": scale, "cut": np.array(cut), "slope": np.array(4 / max(1e-6, np.std(s)))}


def raw_score(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return ((expanded(x) - model["centre"]) / model["scale"]) @ model["w"]


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, parts: int = 5, fit_most: int = FIT_ROWS) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, held_out, score, predicted), one row for each row of docs.

    Only texts are scored; doc_id, lang, source and labels are never inputs. Labels (doc_id, quality) are learnt from
    rows whose crc32 of doc_id modulo `parts` is not 0, at most fit_most of them. held_out: that remainder is 0.
    predicted: 1 if score >= threshold. A null text scores as an empty one; ties score alike; repeated rows are scored
    each on its own; without labels of both kinds every score is the threshold. Empty tables give no rows; other
    columns are ignored. Fitting gathers fit_most rows of features, whatever the tables' size.
    """
    kind = "doc_id long, x array<double>"
    with modest_batches(docs.sparkSession):
        rows = fit_rows(docs, labels, "quality", parts, fit_most)
        seen = rows.select("doc_id", "text").mapInArrow(_features, kind).join(F.broadcast(rows.select("doc_id", "label").distinct()), "doc_id").select("x", "label")
        seen = seen.toPandas()
        x = np.array(seen["x"].tolist(), float).reshape(len(seen), len(STYLE))
        model = fit(x, seen["label"].to_numpy(int)) if len(seen) else {"w": np.zeros(3 * len(STYLE)), "centre": np.zeros(3 * len(STYLE)), "scale": np.ones(3 * len(STYLE)), "cut": np.array(0.0), "slope": np.array(1.0)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, data, off in text_chunks(batch.column(1)):
                    yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(raw_score(model, style(data, off)[0]))], ["doc_id", "s"])

        scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, s double")
        scored = settle(scored, "raw")
        # The cut is that quantile of all texts' scores which the fitted rows of label 0 hold of the fitted rows.
        low = float(np.mean(seen["label"].to_numpy(int) == 0)) if len(seen) and model["w"].any() else 0.0
        cut = scored.agg(F.percentile_approx("s", low, 100_000)).first()[0] or 0.0
        z = (F.col("s") - cut) * float(model["slope"]) + float(np.log(threshold / (1 - threshold)))
        scored = scored.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
        # At the cut itself the score is the threshold, up to rounding.
        return scored.select("doc_id", (fold(F.col("doc_id"), parts) == 0).alias("held_out"), "score", (F.col("s") >= cut).cast("int").alias("predicted"))
