"""The pipeline's stages on rows with nulls, repeated ids, equal rows and clashing names: near copies and decontamination
against brute force, the mix against its targets, shards by ids, toxicity against its own classifier's verdicts."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from siltstone.llm import toxicity

STAGES = dict(corpus_pipeline.STAGES)
KIND = "doc_id long, text string, lang string, source string, n_chars long, whole_row string, row_key long, items int, Hits string, copies string, `a b` string, arrival_ int, key string, size int, own_items int"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def letters(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def texts(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "é", "x-y"]
    base = [rng.choices(vocabulary, k=80) for _ in range(4)]
    rows = []
    for i in range(60):
        t = list(base[i % 4]) if i % 3 else rng.choices(vocabulary, k=rng.choice([1, 3, 7, 60]))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        rows.append((i, " ".join(t)))
    rows += [(70, None), (71, ""), (71, " \n"), (5, rows[8][1]), (5, "another text of that id"), (5, "another text of that id"), (None, rows[8][1]), (None, "no id has this text"), (None, None)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", ["a", "b", None][k % 3], len(t or ""), "own", -k, k, "hit", "c", "ab", 1, "k", 2, 10 * k) for k, (d, t) in enumerate(rows)], KIND)


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = texts()
    spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    items = [(1, " ".join(rows[1][1].split()[:14])), (2, "w1 w2"), (3, rows[0][1]), (4, None), (None, "no id has")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, items


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_toxic_rows_go_and_the_others_are_whole(spark, sides):
    docs = table(spark, texts() + [(200 + i, f"you are an idiot and a moron number {i}") for i in range(9)])
    out = STAGES["toxicity"](spark, docs, sides[0])
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{sides[0]}/labels.parquet"), keep=("items",))
    bad = {r["items"] for r in scored.collect() if r.predicted}
    assert out.columns == docs.columns
    assert Counter(plain(out)) == Counter(r for r in plain(docs) if r[docs.columns.index("items")] not in bad)


def test_one_row_of_each_group_stays(spark, sides):
    docs = table(spark, texts())
    docs = docs.unionByName(docs.where("doc_id = 9"))
    rows, at = plain(docs), docs.columns.index("doc_id")
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        if sets[i]:
            groups.setdefault(find(i), []).append(rows[i])
    out = STAGES["ngram_jaccard"](spark, docs, sides[0])
    kept = plain(out)
    assert out.columns == docs.columns
    assert Counter(r for r in kept if not words(r[1])) == Counter(r for r in rows if not words(r[1]))
    kept = [r for r in kept if words(r[1])]
    assert len(kept) == len(groups) < len(rows)
    for group in groups.values():
        own = [r for r in kept if r in group]
        least = min((r[at] is None, r[at] or 0) for r in group)
        assert len(own) == 1 and (own[0][at] is None, own[0][at] or 0) == least


def test_benchmark_passages_go(spark, sides):
    at, items = sides
    docs = table(spark, texts())
    windows = []
    for _, t in items:
        w = letters(t)
        windows += [w[p : p + 10] for p in range(len(w) - 9)] if len(w) >= 10 else [w] if w else []
    expected = {}
    for r in plain(docs):
        w, hit = letters(r[1]), set()
        for x in windows:
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit |= set(range(p, p + len(x)))
        if not w or len(hit) <= 0.5 * len(w):
            expected[r[docs.columns.index("items")]] = (r, [x for p, x in enumerate(w) if p not in hit], bool(hit))
    out = STAGES["decontamination"](spark, docs, at)
    assert out.columns == docs.columns
    found = {r[docs.columns.index("items")]: r for r in plain(out)}
    assert found.keys() == expected.keys() and any(h for _, _, h in expected.values()) and len(found) < docs.count()
    for k, (row, left, hit) in expected.items():
        assert letters(found[k][1]) == left
        assert found[k][5:] == row[5:] and found[k][2:4] == row[2:4]
        assert found[k] == row if not hit else found[k][4] == len(found[k][1])


def test_the_mix_repeats_whole_rows(spark, sides):
    docs = table(spark, texts())
    rows, source = plain(docs), docs.columns.index("source")
    out = STAGES["mixing"](spark, docs, sides[0])
    times = Counter(plain(out))
    assert out.columns == docs.columns and set(times) <= set(rows) and max(times.values()) <= 3
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[source]] += len(words(r[1]))
        taken[r[source]] += len(words(r[1])) * times[r]
    weights = dict(zip(["a", "b", None], [5, 2, 1]))
    targets, open_ = {}, set(weights)
    while open_:
        left, w = sum(sizes.values()) - sum(targets.values()), sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > 3 * sizes[s]}
        for s in over or open_:
            targets[s] = 3 * sizes[s] if over else left * weights[s] / w
        open_ -= over or open_
    longest = max(len(words(r[1])) for r in rows)
    # Rows of one id share their fate: id 5 has four rows.
    assert all(abs(taken[s] - targets[s]) <= 4 * longest for s in weights)


def test_shards_hold_every_row(spark, sides):
    docs = table(spark, texts())
    out = STAGES["sharding"](spark, docs, sides[0])
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in docs.collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_an_empty_table_stays_empty(spark, sides, name):
    docs = table(spark, texts()).limit(0)
    out = STAGES[name](spark, docs, sides[0])
    assert out.count() == 0 and (name == "sharding" or out.columns == docs.columns)
