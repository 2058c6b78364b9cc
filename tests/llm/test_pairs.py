"""The Jaccard join's pairs against brute force, within components too."""

import random
import re
from collections import Counter

import corpus_pipeline
from siltstone.llm import jaccard_join, queries


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def test_every_link_is_returned(spark):
    rng = random.Random(5)
    words, rows = [f"w{i}" for i in range(300)], [(900, None), (901, ""), (None, "w1 w2"), (902, "w1 w2")]
    for g in range(5):
        base = rng.choices(words, k=70)
        for i in range(9):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(70)] = rng.choice(words)
            rows.append((g * 10 + i, " ".join(t)))
    every = [sets(t, 4) for _, t in rows]
    linked = lambda x, y: bool(x and y) and 100 * len(x & y) >= 60 * len(x | y)
    want = Counter((str(rows[i][0]), sum(i != j and linked(x, y) for j, y in enumerate(every))) for i, x in enumerate(every))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, links = jaccard_join.similar_pairs(docs, k=4, percent=60)
    assert Counter((str(r.doc_id), r.n_links) for r in got.collect()) == want
    kinds = sorted(set(every) - {frozenset()}, key=sorted)
    pairs = sum(linked(x, y) for i, x in enumerate(kinds) for y in kinds[:i])
    assert links.count() == pairs > len(kinds)


def roots_by_force(rows, k, percent):
    every, parent = [sets(t, k) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(every):
        for j in range(i):
            y = every[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def near_copies(rng, n, words, most, at):
    """n texts, each with up to `most` changes of one text that is not among them."""
    base, rows = rng.choices(words, k=200), []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randint(2, most)):
            t[rng.randrange(200)] = rng.choice(words)
        rows.append((at + i, " ".join(t)))
    return rows


def test_near_copies_of_an_absent_text(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = near_copies(rng, 300, words, 6, 1000)
    want = roots_by_force(rows, 5, 80)
    assert 3 < len(set(want.values())) < 300  # many of them do not link with each other
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pick = lambda: {r.doc_id: r.component_id for r in jaccard_join.similar_classes(docs, k=5, percent=80).collect()}
    assert pick() == want
    monkeypatch.setattr(jaccard_join, "FEW_WITHIN", 5)  # several levels of groups
    assert pick() == want


def test_two_groups_that_share_a_passage(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choices(words, k=40))
    rows = [(d, t + " " + shared) for d, t in near_copies(rng, 60, words, 6, 0) + near_copies(rng, 60, words, 6, 500)] + [(900, shared), (901, shared), (902, None)]
    want = roots_by_force(rows, 5, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "FEW", 4)
    monkeypatch.setattr(jaccard_join, "FEW_WITHIN", 8)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_classes(docs, k=5, percent=80, common_from=1000).collect()}
    assert got == want and max(Counter(want.values()).values()) > 10


def linked_clusters(rng, each, k=5):
    """k clusters of `each` near copies of a 60-word base, with three texts between each two: half of either base."""
    words = [f"w{i}" for i in range(2000)]
    bases, rows = [rng.choices(words, k=60) for _ in range(k)], []
    for base in bases:
        for _ in range(each):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                t[rng.randrange(60)] = rng.choice(words)
            rows.append(t)
    for x, y in zip(bases, bases[1:]):
        for j in range(3):
            rows.append([*x[:30], f"own{j}", *y[30:]])
    rng.shuffle(rows)
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


def compared(monkeypatch):
    """Counts the pairs whose sets are compared, and the pairs of bases."""
    counts = Counter()
    verified, within, between = jaccard_join._verified, jaccard_join._within_groups, jaccard_join._between_parts

    def count_verified(pairs, *rest):
        counts["pairs"] += pairs.count()
        return verified(pairs, *rest)

    def count_within(*args):
        found = within(*args)
        counts["links"] += sum(x.count() for x in found)
        return found

    monkeypatch.setattr(jaccard_join, "_verified", count_verified)
    monkeypatch.setattr(jaccard_join, "_within_groups", count_within)
    return counts


def test_linked_clusters_are_joined_without_their_square(spark, monkeypatch):
    found = {}
    for each in (40, 160):
        rows = linked_clusters(random.Random(each), each)
        counts = compared(monkeypatch)
        got = jaccard_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), k=4, percent=85)
        assert {r.doc_id: r.component_id for r in got.collect()} == roots_by_force(rows, 4, 85)
        monkeypatch.undo()
        found[each] = counts["pairs"] + counts["links"]
    assert found[160] <= 4.5 * found[40] and found[160] < 12 * 5 * 160


def test_clusters_that_chain_across_parts(spark):
    """Bases at rising distance of each other, so that members of different parts link."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base, rows = rng.choices(words, k=120), []
    for _ in range(6):
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(120)] = rng.choice(words)
            rows.append(t)
        base = [*base[:80], *rng.choices(words, k=40)] if rng.random() < 0.5 else [rng.choice(words) if i % 23 == 0 else w for i, w in enumerate(base)]
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    got = jaccard_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k=4, percent=80)
    assert {r.doc_id: r.component_id for r in got.collect()} == roots_by_force(rows, 4, 80)


def test_the_query_joins_parts_of_long_lists(spark, tmp_path):
    """One text becomes another in steps that just link: lists of more than FEW classes, whose ends are far apart."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    x, y = rng.choices(words, k=200), rng.choices(words, k=200)
    steps = [" ".join([*y[: 12 * j], *x[12 * j :]]) for j in range(17)]
    texts = [t + f" own{i}" for j, t in enumerate(steps) for i in range(20 if j % 16 == 0 else 3)]
    rows = [(7 * i % 1009 + 5, t) for i, t in enumerate(texts)] + [(2000, " ".join(rng.choices(words, k=9))), (1, ""), (2, None)]
    want = roots_by_force(rows, 4, 85)
    assert Counter(want.values()).most_common(1)[0][1] == len(texts)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_ngram_jaccard(spark, str(tmp_path)).collect()}
    assert got == {d: (len(sets(t, 4)), want[d]) for d, t in rows}


def test_near_copies_in_long_lists_leave_the_pipeline(spark):
    rows = linked_clusters(random.Random(2), 24, k=2)
    docs = spark.createDataFrame([(d, t, "web") for d, t in rows] + [(900, None, "web"), (901, " ", "web")], "doc_id long, text string, source string")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({*roots_by_force(rows, 5, 80).values(), 900, 901})
