"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model of their accuracies and
correlations, and a linear classifier trained on the posterior labels it gives."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import drop_settled, modest_batches, settle, text_chunks, with_columns
from siltstone.llm.features import STYLE, style
from siltstone.llm.quality_classifier import fit_rows, fold
from siltstone.llm.wordarrays import BY_LETTER, span_hashes, spans

#: Words of insult and abuse, by kind; each list is a voter.
LEXICONS: dict[str, tuple[str, ...]] = {
    "stupidity": ("idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "imbecile", "dumb", "dumbass", "halfwit", "dimwit", "cretin", "simpleton"),
    "contempt": ("loser", "losers", "pathetic", "worthless", "useless", "failure", "nobody", "inferior"),
    "disgust": ("disgusting", "trash", "scum", "filth", "filthy", "garbage", "vermin", "vile", "repulsive"),
    "mockery": ("clown", "clowns", "buffoon", "freak", "weirdo", "fool", "jerk"),
    "obscenity": ("fuck", "fucking", "fucked", "shit", "shitty", "bullshit", "bitch", "bastard", "asshole", "crap", "damn", "piss"),
    "slur": ("slut", "whore", "retard", "retarded", "pervert", "degenerate"),
    "threat": ("kill", "murder", "strangle", "destroy", "hang", "die"),
    "german": ("arschloch", "scheisse", "scheiße", "dummkopf", "vollidiot", "wichser", "hurensohn", "abschaum"),
    "french": ("connard", "connasse", "merde", "salope", "enculé", "imbécile", "crétin", "ordure"),
    "spanish": ("gilipollas", "mierda", "puta", "cabrón", "estúpido", "imbécil", "idiota", "basura"),
}
#: Kinds whose words are also harmless: they need company to count.
WEAK = ("threat", "contempt")
#: Words mined from the fitted rows: each in at least this share of the toxic rows (and in three) and this many times
#: likelier there. The first bytes that STEM_WORDS of them share are a stem.
MINED_SHARE, MINED_LIFT, CHANCE = 0.004, 25.0, 0.05
STEM_BYTES, STEM_WORDS = 6, 3
FIT_ROWS = 20_000
#: What two voters must tell of each other, as a gain of log likelihood, to be joined; what a rate begins with, in rows.
LEAST_TOLD, SMOOTH = 10.0, 1.0
#: Posteriors from which on a text shows words, as toxic or, below the rest, as other.
SURE = 0.9
VOTERS = (*LEXICONS, "mined", "mined_often", "stems", "two_kinds", "dense", "shouted", "pointed")


def word_hashes(words: list[str]) -> np.ndarray:
    out = []
    for _, _, data, off in text_chunks(pa.array(words, pa.string())):
        s, e, _ = spans(data, off, BY_LETTER)
        out.append(span_hashes(data, s, e))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _head_hash(head: bytes) -> int:
    return int(span_hashes(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]))[0])


class Lexicon:
    def __init__(self, mined: list[bytes]):
        kinds = [word_hashes(list(x)) for x in LEXICONS.values()] + [word_hashes([x.decode() for x in mined])]
        heads, times = np.unique(np.array([x[:STEM_BYTES] for x in mined if len(x) > STEM_BYTES], f"S{STEM_BYTES}"), return_counts=True)
        self.stems = np.sort(np.array([_head_hash(bytes(x)) for x in heads[times >= STEM_WORDS]], np.uint64))
        self.words = np.unique(np.concatenate(kinds))
        self.kinds = np.stack([np.isin(self.words, k) for k in kinds]).astype(np.int64)
        self.you = np.sort(word_hashes(["you", "your", "youre", "u", "du", "tu", "vous", "eres"]))
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.words >> np.uint64(48)).astype(np.int64)] = True

    def measures(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(votes: 1, or 0 for no vote; numbers for the classifier) of each text."""
        starts, ends, first = spans(data, off, BY_LETTER)
        h = span_hashes(data, starts, ends)
        n = len(off) - 1
        at = np.flatnonzero(self.table[(h >> np.uint64(48)).astype(np.int64)])
        j = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
        good = self.words[j] == h[at]
        at, j = at[good], j[good]
        text = np.searchsorted(first, at, "right") - 1
        counts = np.stack([np.bincount(text, k[j], n) for k in self.kinds], axis=1) if len(at) else np.zeros((n, len(self.kinds)))
        strong = np.bincount(text, (self.kinds[:, j].sum(0) > self.kinds[[list(LEXICONS).index(w) for w in WEAK]][:, j].sum(0)).astype(float), n) if len(at) else np.zeros(n)
        near = np.zeros(n)
        if len(at):
            for shift in (-3, -2, -1):
                k = at + shift
                inside = (k >= 0) & (k >= first[text])
                w = h[np.maximum(k, 0)]
                y = np.minimum(np.searchsorted(self.you, w), len(self.you) - 1)
                near += np.bincount(text, (inside & (self.you[y] == w)).astype(float), n)
        stems = np.zeros(n)
        if len(self.stems):
            long = np.flatnonzero(ends - starts > STEM_BYTES)
            head = span_hashes(data, starts[long], starts[long] + STEM_BYTES)
            y = np.minimum(np.searchsorted(self.stems, head), len(self.stems) - 1)
            stems = np.bincount(np.searchsorted(first, long[self.stems[y] == head], "right") - 1, minlength=n).astype(float)
        sty, _ = style(data, off)
        words = np.maximum(np.diff(first), 1)
        hits = np.bincount(text, minlength=n).astype(float) if len(at) else np.zeros(n)
        kinds = (counts > 0).sum(1)
        votes = np.concatenate([counts > 0, np.stack([counts[:, -1] >= 2, stems >= 2, kinds >= 2, hits / words > 0.01, (hits > 0) & (sty[:, STYLE.index("upper")] > 0.5), near > 0], axis=1)], axis=1)
        numbers = np.stack([np.minimum(strong, 5), np.minimum(hits, 10) / 2, (strong > 0).astype(float), np.minimum(hits / words * 20, 2), np.minimum(kinds, 5), np.minimum(near, 3), (counts[:, -1] > 0).astype(float), np.minimum(counts[:, -1], 4), np.minimum(stems, 4)], axis=1)
        return votes.astype(np.int8), numbers


class LabelModel:
    """P(toxic) and, for toxic and other texts alike, a tree of voters: each fires with a probability that depends on
    whether its parent in the tree does, so pairs of voters that correlate beyond the hidden label have a factor of their
    own and do not count twice. Fitted by EM on counts of vote patterns, labelled rows with the label that they have.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior: float, toxic: np.ndarray, clean: np.ndarray, rounds: int = 30, anchored: float = 1.0):
        """toxic, clean: patterns of labelled rows of either kind. All patterns together weigh `anchored` times as much as
        the labelled rows, if they are more, so that the hidden label keeps its meaning."""
        m = patterns.shape[1]
        rows = np.concatenate([patterns, toxic.reshape(-1, m), clean.reshape(-1, m)]).astype(np.int64)
        labelled = len(toxic) + len(clean)
        share = min(1.0, anchored * labelled / max(counts.sum(), 1)) if labelled else 1.0
        weight = np.concatenate([np.asarray(counts, float) * share, np.ones(labelled)])
        known = np.concatenate([np.full(len(patterns), np.nan), np.ones(len(toxic)), np.zeros(len(clean))])
        self.prior, self.parent = min(max(prior, 1e-3), 0.5), np.full(m, -1)
        # rates to begin with: those of the labelled rows, or what lexicons are made for
        start = [(toxic.sum(0) + 0.05 * 5) / (len(toxic) + 5.0) if len(toxic) else np.full(m, 0.5), (clean.sum(0) + 0.01 * 5) / (len(clean) + 5.0) if len(clean) else np.full(m, 0.002)]
        self.on = np.stack([np.stack([x, x], axis=1) for x in start])  # [toxic or other, voter, parent silent or firing]
        self.likelihoods: list[float] = []
        for k in range(rounds):
            q = np.where(np.isnan(known), self.posterior(rows), known)
            if k in (1, 5):
                self.parent = self._tree(rows, weight, q)
            self._fit(rows, weight, q)
            self.likelihoods.append(self._likelihood(rows, weight, known))

    def _tree(self, rows: np.ndarray, weight: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Each voter's parent in the forest of pairs that tell most of each other, the label known; -1 for none."""
        x, m = rows.astype(float), rows.shape[1]
        told = np.zeros((m, m))
        for w in (weight * q, weight * (1 - q)):
            n = w.sum() + 4.0
            both = (x * w[:, None]).T @ x
            one = w @ x
            cells = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both, (0, 0): w.sum() - one[:, None] - one[None, :] + both}
            cells = {k: np.maximum(v, 0) + 1.0 for k, v in cells.items()}
            rate = {v: sum(cells[v, u] for u in (0, 1)) / n for v in (0, 1)}
            other = {v: sum(cells[u, v] for u in (0, 1)) / n for v in (0, 1)}
            told += sum(cells[u, v] / n * np.log(cells[u, v] / n / (rate[u] * other[v])) for u in (0, 1) for v in (0, 1)) * n
        np.fill_diagonal(told, 0)
        parent, inside = np.full(m, -1), np.zeros(m, bool)
        best, by = np.full(m, -np.inf), np.full(m, -1)
        for _ in range(m):
            j = int(np.argmax(np.where(inside, -np.inf, best))) if (best[~inside] > LEAST_TOLD).any() else int(np.flatnonzero(~inside)[0])
            parent[j] = by[j] if best[j] > LEAST_TOLD else -1
            inside[j] = True
            better = ~inside & (told[j] > best)
            best[better], by[better] = told[j][better], j
        return parent

    def _given(self, rows: np.ndarray) -> np.ndarray:
        """Whether each voter's parent fires; 0 for those without."""
        return np.where(self.parent >= 0, rows[:, np.maximum(self.parent, 0)], 0)

    def _fit(self, rows: np.ndarray, weight: np.ndarray, q: np.ndarray) -> None:
        given, at = self._given(rows), np.arange(rows.shape[1])
        for y, w in enumerate((weight * q, weight * (1 - q))):
            mean = (w @ rows + SMOOTH * 0.01) / (w.sum() + SMOOTH)
            for v in (0, 1):
                here = (given == v) * w[:, None]
                self.on[y, at, v] = np.clip(((here * rows).sum(0) + SMOOTH * mean) / (here.sum(0) + SMOOTH), 1e-6, 1 - 1e-6)
        self.prior = float(np.clip((weight @ q + 0.5) / (weight.sum() + 1.0), 1e-3, 0.5))

    def _logs(self, rows: np.ndarray) -> np.ndarray:
        """log P(votes, toxic) and log P(votes, other) of each row."""
        given, at = self._given(rows), np.arange(rows.shape[1])
        out = []
        for y, base in enumerate((self.prior, 1 - self.prior)):
            p = self.on[y][at[None, :], given]
            out.append(np.log(base) + np.log(np.where(rows == 1, p, 1 - p)).sum(1))
        return np.stack(out, axis=1)

    def _likelihood(self, rows: np.ndarray, weight: np.ndarray, known: np.ndarray) -> float:
        logs = self._logs(rows)
        return float(weight @ np.where(np.isnan(known), np.logaddexp(logs[:, 0], logs[:, 1]), np.where(known == 1, logs[:, 0], logs[:, 1])))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of each row."""
        logs = self._logs(np.asarray(votes).astype(np.int64))
        return 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -30, 30)))


def logistic(x: np.ndarray, q: np.ndarray, c: np.ndarray, l2: float = 1e-4) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression on soft labels q of weight c."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-8
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (c * (p - q)) / c.sum() + penalty * w
        hessian = (x * (c * p * (1 - p))[:, None]).T @ x / c.sum() + np.diag(penalty + 1e-7)
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-5:
            break
    return w


def _mined(rows: DataFrame) -> list[bytes]:
    """The words that toxic texts of rows (text, label) have and the others hardly ever; equal texts count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, off in text_chunks(batch.column(0)):
                s, e, first = spans(data, off, BY_LETTER)
                h = span_hashes(data, s, e)
                parts = [a + np.unique(h[a:b], return_index=True)[1] for a, b in zip(first[:-1], first[1:], strict=True)]
                for kind in (0, 1):
                    own = [p for p, y in zip(parts, label[i:j], strict=True) if y == kind]
                    if own:
                        at = np.concatenate(own)
                        _, one, c = np.unique(h[at], return_index=True, return_counts=True)
                        words = [data[s[x] : e[x]].tobytes().lower() for x in at[one].tolist()]
                        yield pa.record_batch([pa.array(words, pa.binary()), pa.array(c * kind), pa.array(c * (1 - kind))], ["w", "bad", "good"])

    rows = rows.dropDuplicates(["text"])
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1:
        return []
    words = rows.select("text", "label").mapInArrow(run, "w binary, bad long, good long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    words = settle(words, "mined")
    # Among so many words some are in toxic texts only by chance: by Chernoff's bound less than CHANCE of them get through.
    share, every, both = n1 / (n1 + n0), words.count(), F.col("bad") + F.col("good")
    part = lambda x, of: F.when(x > 0, x * F.log(x / both / of)).otherwise(0.0)
    told = part(F.col("bad"), share) + (part(F.col("good"), 1 - share) if n0 else F.lit(0.0))
    found = words.where((F.col("bad") >= max(3, MINED_SHARE * n1)) & (F.col("bad") / n1 >= MINED_LIFT * (F.col("good") + 0.5) / (n0 + 1)) & (told >= math.log(max(every, 1) / CHANCE)))
    return sorted(bytes(r.w) for r in found.select("w").collect())


def sampled(docs: DataFrame, parts: int, most: int) -> DataFrame:
    """(doc_id, text) of at most `most` documents outside the held-out fold, those of the smallest md5 of doc_id, one text
    an id."""
    ids = docs.select("doc_id").where((fold(F.col("doc_id"), parts) != 0) & F.col("doc_id").isNotNull()).distinct()
    ids = ids.withColumn("h", F.md5(F.col("doc_id").cast("string").cast("binary"))).orderBy("h").limit(most).select("doc_id")
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "doc_id")
    return own.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def _numbers(lexicon: Lexicon):
    """(id, text) -> (id, p: the votes as bits, x: the classifier's numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column(1)):
                votes, x = lexicon.measures(data, off)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(votes @ (1 << np.arange(votes.shape[1], dtype=np.int64))), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "p", "x"])

    return run


def _bits(p) -> np.ndarray:
    return ((np.asarray(p, np.int64)[:, None] >> np.arange(len(VOTERS))) & 1).astype(np.int8)


def fit(docs: DataFrame, labels: DataFrame, parts: int, fit_most: int):
    """(lexicon, label model, classifier's weights).

    First the voters are the lexicons and the words that labelled toxic texts show. A label model of labelled rows and a
    sample of all documents gives the sample posterior labels, and these show more words: an insult that no list has is
    found by the company that it keeps. The final label model counts the vote patterns of all documents; the classifier is
    trained on its posteriors of the sample and the labelled rows, never on the labels themselves.
    """
    kind = "doc_id long, p long, x array<double>"
    rows = settle(fit_rows(docs, labels, "toxic", parts, fit_most), "labelled")
    some = settle(sampled(docs, parts, fit_most), "sample")

    def seen(frame: DataFrame, lexicon: Lexicon):
        return frame.select(F.col("doc_id").cast("long"), "text").mapInArrow(_numbers(lexicon), kind).orderBy("doc_id").toPandas()

    def model_of(lexicon: Lexicon, patterns: np.ndarray, counts: np.ndarray):
        own = seen(rows, lexicon).merge(marks, on="doc_id")
        p, y = _bits(own["p"].to_numpy(np.int64)), own["label"].to_numpy(int)
        return LabelModel(patterns, counts, float(np.mean(y)) if len(y) else 0.05, p[y == 1], p[y == 0]), own

    marks = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "label").toPandas()
    lexicon = Lexicon(_mined(rows))
    first = seen(some, lexicon)
    kinds, counts = np.unique(first["p"].to_numpy(np.int64), return_counts=True)
    model, _ = model_of(lexicon, _bits(kinds), counts.astype(float))
    sure = model.posterior(_bits(first["p"].to_numpy(np.int64)))
    told = docs.sparkSession.createDataFrame([(int(i), int(x > 0.5)) for i, x in zip(first["doc_id"], sure, strict=True) if x > SURE or x < 1 - SURE], "doc_id long, label int")
    unlabelled = some.join(F.broadcast(told), "doc_id").join(F.broadcast(rows.select("doc_id")), "doc_id", "left_anti").select("text", "label")
    lexicon = Lexicon(_mined(settle(rows.select("text", "label").unionByName(unlabelled), "told")))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for _, _, data, off in text_chunks(batch.column(0)):
                votes, _ = lexicon.measures(data, off)
                for p, c in zip(*np.unique(votes @ (1 << np.arange(votes.shape[1], dtype=np.int64)), return_counts=True), strict=True):
                    total[int(p)] = total.get(int(p), 0) + int(c)
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["p", "c"])

    every = docs.select(F.col("text").cast("string")).mapInArrow(patterns, "p long, c long").groupBy("p").agg(F.sum("c").alias("c")).orderBy("p").toPandas()
    model, own = model_of(lexicon, _bits(every["p"].to_numpy(np.int64)), every["c"].to_numpy(float))
    both = pd.concat([own[["doc_id", "p", "x"]], seen(some, lexicon)]).drop_duplicates("doc_id")
    drop_settled(rows, some)
    if not len(both):  # nothing to fit on: the posterior alone, as a function of the hits
        x = np.concatenate([np.zeros((1, 9)), np.array([[1, 0.5, 1, 0.4, 1, 0, 0, 0, 0]])])
        return lexicon, model, logistic(x, np.array([0.02, 0.9]), np.ones(2))
    q = model.posterior(_bits(both["p"].to_numpy(np.int64)))
    return lexicon, model, logistic(np.array(both["x"].tolist(), float), q, np.ones(len(both)))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, parts: int = 5, fit_most: int = FIT_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, held_out, score, predicted, *keep), one row for each row of docs.

    Only texts are scored. Labels (doc_id, toxic) are learnt from rows whose crc32 of doc_id modulo `parts` is not 0, at
    most fit_most of them: they anchor the voters' rates and give the mined voter its words. held_out: the remainder is
    0. predicted: 1 if score >= threshold. A null text scores as an empty one; ties score alike; repeated rows are scored
    each on its own; without labels the lexicons' built-in rates hold. Empty tables give no rows; columns that are not in
    keep are ignored, and keep may name a column as a result only if it is not one of the result's own.
    """
    with modest_batches(docs.sparkSession):
        lexicon, _, w = fit(docs, labels, parts, fit_most)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("scored_text"), *[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column(1)):
                _, x = lexicon.measures(data, off)
                s = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
                rest = [c.slice(i, j - i) for c in batch.columns[2:]]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *rest], ["doc_id", "score", "predicted", *keep])

    schema = with_columns([src.schema[c] for c in keep], "doc_id long, score double, predicted int", kept_first=False)
    return src.mapInArrow(run, schema).select("doc_id", (fold(F.col("doc_id"), parts) == 0).alias("held_out"), "score", "predicted", *[F.col(f"`{c}`") for c in keep])
