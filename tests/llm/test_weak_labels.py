"""The label model and the ranking against plain loops, and an insult that no list has."""

import itertools
import math
import random

import numpy as np
import pytest

from siltstone.llm import quality_classifier, toxicity


def joint(model, votes, toxic):
    """P(votes, label) voter by voter."""
    out = model.prior if toxic else 1 - model.prior
    for j, v in enumerate(votes):
        parent = model.parent[j]
        p = model.on[0 if toxic else 1][j][votes[parent] if parent >= 0 else 0]
        out *= p if v else 1 - p
    return out


def drawn(rng, n, m=6):
    """Texts' votes: voters of several rates; the last two copy the first mostly."""
    rows, y = [], []
    for _ in range(n):
        t = rng.random() < 0.3
        v = [int(rng.random() < (0.7 - 0.1 * j if t else 0.05 + 0.02 * j)) for j in range(m - 2)]
        v += [v[0] if rng.random() < 0.95 else 1 - v[0] for _ in range(2)]
        rows.append(v)
        y.append(int(t))
    return np.array(rows), np.array(y)


@pytest.fixture(scope="module")
def fitted():
    rows, y = drawn(random.Random(1), 3000)
    kinds, counts = np.unique(rows[300:], axis=0, return_counts=True)
    model = toxicity.LabelModel(kinds, counts.astype(float), 0.3, rows[:300][y[:300] == 1], rows[:300][y[:300] == 0])
    return model, rows, y


def test_posterior_is_that_of_all_outcomes(fitted):
    model, rows, _ = fitted
    every = list(itertools.product((0, 1), repeat=rows.shape[1]))
    assert math.isclose(sum(joint(model, v, t) for v in every for t in (0, 1)), 1, rel_tol=1e-9)
    want = [joint(model, v, 1) / (joint(model, v, 1) + joint(model, v, 0)) for v in every]
    assert np.allclose(model.posterior(np.array(every)), want)


def test_em_step_by_step(fitted):
    _, rows, y = fitted
    kinds, counts = np.unique(rows[300:], axis=0, return_counts=True)
    toxic, clean = rows[:300][y[:300] == 1], rows[:300][y[:300] == 0]
    model = toxicity.LabelModel(kinds, counts.astype(float), 0.3, toxic, clean, rounds=8)
    after = toxicity.LabelModel(kinds, counts.astype(float), 0.3, toxic, clean, rounds=9)
    assert (model.parent == after.parent).all()
    share, m, s = min(1.0, 300 / counts.sum()), rows.shape[1], toxicity.SMOOTH
    told = [(v, share * c, model.posterior(v[None])[0]) for v, c in zip(kinds, counts)] + [(v, 1.0, 1.0) for v in toxic] + [(v, 1.0, 0.0) for v in clean]
    for label in (0, 1):
        weight = [w * (q if label == 0 else 1 - q) for _, w, q in told]
        for j in range(m):
            mean = (sum(w for (v, _, _), w in zip(told, weight) if v[j]) + 0.01 * s) / (sum(weight) + s)
            for given in (0, 1):
                here = [(v[j], w) for (v, _, _), w in zip(told, weight) if (v[model.parent[j]] if model.parent[j] >= 0 else 0) == given]
                want = (sum(w for x, w in here if x) + s * mean) / (sum(w for _, w in here) + s)
                assert math.isclose(after.on[label, j, given], min(max(want, 1e-6), 1 - 1e-6), rel_tol=1e-9)
    assert math.isclose(after.prior, (sum(w * q for _, w, q in told) + 0.5) / (sum(w for _, w, _ in told) + 1), rel_tol=1e-9)


def test_likelihood_rises_and_copies_are_joined(fitted):
    model, rows, y = fitted
    steps = np.diff(model.likelihoods[6:])
    assert (steps > -1e-2).all() and model.likelihoods[-1] > model.likelihoods[0]
    linked = {frozenset((j, int(p))) for j, p in enumerate(model.parent) if p >= 0}
    assert len(linked & {frozenset(x) for x in ((0, 4), (0, 5), (4, 5))}) == 2
    # three voters that say one thing weigh about as much as one
    one, three = np.array([[1, 0, 0, 0, 0, 0]]), np.array([[1, 0, 0, 0, 1, 1]])
    odds = lambda v: math.log(model.posterior(v)[0] / (1 - model.posterior(v)[0]))
    silent = odds(np.zeros((1, 6)))
    assert odds(three) - silent < 1.5 * math.log((0.7 / 0.05) / (0.3 / 0.95)) and odds(three) > odds(one) - 3
    right = ((model.posterior(rows) > 0.5) == y).mean()
    best = np.mean((np.array([joint_true(v) for v in rows]) > 0.5) == y)
    assert right > best - 0.02


def joint_true(v):
    p = [0.3, 0.7]
    for j in range(4):
        on, off = 0.7 - 0.1 * j, 0.05 + 0.02 * j
        p[0] *= on if v[j] else 1 - on
        p[1] *= off if v[j] else 1 - off
    return p[0] / (p[0] + p[1])


def test_an_insult_in_no_list_is_found_by_its_company(spark):
    rng = random.Random(3)
    calm = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(calm, k=40)
        kind = "clean"
        if i % 5 == 0:
            kind = "toxic"
            for w in rng.sample(["idiot", "moron", "stupid", "scum", "trash", "clown"], 3):
                words.insert(rng.randrange(40), w)
            if i % 2 == 0 and i >= 300:
                words += ["zorblax", "zorblax"]  # only where nobody has labelled
        if i % 225 == 7:
            kind = "alone"
            words += ["zorblax", "zorblax"]
        rows.append((i, " ".join(words), kind))
        if i < 300 and kind != "alone":
            labels.append((i, int(kind == "toxic")))
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), keep=("kind",)).collect()
    found = {k: np.mean([r.predicted for r in got if r.kind == k]) for k in ("clean", "toxic", "alone")}
    assert found["clean"] == 0 and found["toxic"] == 1 and found["alone"] == 1


def test_words_in_toxic_texts_by_chance_are_not_mined(spark):
    rng = random.Random(4)
    rows = [(" ".join([f"r{rng.randrange(4000)}" for _ in range(60)] + ["zorblax"] * (i % 6 == 0)), int(i % 6 == 0)) for i in range(300)]
    assert toxicity._mined(spark.createDataFrame(rows, "text string, label int")) == [b"zorblax"]


def test_ranking_is_where_the_loss_of_pairs_is_least():
    rng = np.random.default_rng(2)
    x = rng.random((120, len(quality_classifier.STYLE)))
    y = (x[:, 0] + 0.3 * rng.random(120) > 0.7).astype(int)
    pairs, l2 = 4000, 1e-2
    model = quality_classifier.fit(x, y, pairs=pairs, l2=l2, seed=5)
    z = (quality_classifier.expanded(x) - model["centre"]) / model["scale"]
    draw = np.random.default_rng(5)
    good, bad = draw.choice(np.flatnonzero(y == 1), pairs), draw.choice(np.flatnonzero(y == 0), pairs)

    def loss(w):
        total = 0.0
        for g, b in zip(good, bad):
            total += math.log1p(math.exp(-float((z[g] - z[b]) @ w)))
        return total / pairs + l2 / 2 * float(w @ w)

    at = loss(model["w"])
    for j in range(0, len(model["w"]), 7):
        for step in (1e-3, -1e-3):
            moved = model["w"].copy()
            moved[j] += step
            assert loss(moved) >= at - 1e-9
    scores = sorted(float(v) for v in z @ model["w"])
    share = float(np.mean(y == 0)) * (len(scores) - 1)
    low, high = scores[int(share)], scores[min(int(share) + 1, len(scores) - 1)]
    assert math.isclose(float(model["cut"]), low + (share - int(share)) * (high - low), rel_tol=1e-9)


def test_quality_cut_over_all_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.score_quality(docs, labels).toPandas()
    fitted = quality_classifier.fit_rows(docs, labels, "quality", 5, quality_classifier.FIT_ROWS).toPandas()
    low = (fitted.label == 0).mean()
    assert ((got.score >= 0.3 - 1e-9) == (got.predicted == 1)).all()
    assert abs((got.predicted == 0).mean() - low) <= 2 / len(got) + 1e-9
