"""Each operator against brute force on small tables with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.llm import chat_format, decontaminate, jaccard_join, license_scan, lm_score, mixing, quality_classifier, quality_rules, sharding, toxicity
from siltstone.llm.common import new_dir
from siltstone.llm.components import connected_components

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string, lang string, source string, n_chars long, n_words string, items int, cls string, score string, at int, run int"


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(TABLE))


def lettered(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(TABLE))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(50)] + ["The", "of", "é", "ÀB", "x-y", "a.b"]
    base = [rng.choices(words, k=60) for _ in range(4)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base)) if i % 2 else rng.choices(words, k=rng.choice([1, 2, 3, 5, 40, 90]))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "  ", "\n", "\t"]).join(t)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "solo"), (n + 4, "solo"), (5, rows[5][1]), (n + 5, "long " * 30_000), (n + 6, "x" * 2_500_000)]
    return rows


def frame(spark, rows):
    full = [(i, t, "en", ["a", "b", None][(i or 0) % 3], len(t or ""), "clash", 1, "clash", "clash", 2, 3) for i, t in rows]
    return spark.createDataFrame(full, KIND)


def test_decontaminate(spark):
    rows = corpus()
    items = [(1, " ".join(spaced(rows[1][1])[:30])), (22, " ".join(spaced(rows[3][1])[5:18])), (3, "w1 W2"), (4, None), (5, ""), (6, "solo"), (7, "w1 w2"), (None, "w3 w4 w5")]
    found = {}
    for r in decontaminate.find_contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), with_text=True).collect():
        found.setdefault(r.doc_id, []).append(r)
    windows = []
    for i, t in items:
        w = lettered(t)
        windows += [(i, w[p : p + 10]) for p in range(len(w) - 9)] if len(w) >= 10 else ([(i, w)] if w else [])
    assert sum(map(len, found.values())) == len(rows)
    for d, t in rows:
        w, hit, ids = lettered(t), set(), set()
        if len(w) < 5000:
            for i, x in windows:
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        hit |= set(range(p, p + len(x)))
                        ids |= {str(i)} - {"None"}
        for r in found[d]:
            assert (r.n_words, r.n_hit, r.items) == (len(w), len(hit), sorted(ids)), d
            if t is not None:
                cut = "".join(c for k, c in enumerate(t) if not any(s.start <= k < s.end for s in r.spans))
                assert r.clean_text == cut
    assert decontaminate.find_contamination(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.find_contamination(frame(spark, rows[:9]), spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_decontaminate_in_passes(spark, monkeypatch):
    rows = corpus(2, 20)
    items = spark.createDataFrame([(i, " ".join(spaced(rows[2 * i + 1][1])[:20])) for i in range(6)], "item_id long, text string")
    pick = lambda: sorted((r.doc_id, r.n_hit, tuple(r.items)) for r in decontaminate.find_contamination(frame(spark, rows), items).collect())
    once = pick()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    assert pick() == once and any(x[1] for x in once)


def test_decontaminated_documents(spark):
    text = "alpha beta " + " ".join(f"q{i}" for i in range(12)) + " omega end of it and some more words here that stay on"
    docs = frame(spark, [(1, text), (2, " ".join(f"q{i}" for i in range(12))), (3, None), (4, "clean")])
    out = decontaminate.decontaminate(docs, spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(12)))], "item_id long, text string"))
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 3, 4} and got[1].text == "alpha beta  omega end of it and some more words here that stay on" and got[1].n_chars == len(got[1].text)


def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT"][2]
    rows = [(1, "Some text\nReleased under the MIT License.\nmore"), (2, mit), (3, "intro\n\n" + mit.replace(". ", ".\n") + "\n\nend"), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0."), (7, "the of and " * 5000), (1, "released under THE mit license")]
    got = sorted((r.doc_id, ",".join(r.licenses), r.best_license) for r in license_scan.scan_licenses(frame(spark, rows)).collect())
    assert got == sorted([(1, "MIT", "MIT"), (2, "MIT", "MIT"), (3, "MIT", "MIT"), (4, "", None), (5, "", None), (6, "CC-BY-NC-4.0", "CC-BY-NC-4.0"), (7, "", None), (1, "MIT", "MIT")], key=lambda x: (x[0], x[1]))
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0


def test_licenses_against_brute_force(spark):
    rng = random.Random(3)
    templates = {"A": ("alpha beta gamma delta epsilon zeta eta theta iota kappa",), "B": ("alpha beta gamma delta epsilon zeta eta theta iota lambda", "one two three four five six"), "C": ("one two three four five six",)}
    words = sorted({w for ts in templates.values() for t in ts for w in t.split()}) + ["x", "y"]
    rows = [(0, None), (1, ""), (2, "One, two three! FOUR five six"), (3, "one two three four five six " * 3), (4, "alpha beta gamma\ndelta epsilon zeta eta\ntheta iota kappa\nx"), (5, "alpha beta gamma delta\n\n\nepsilon zeta\n\neta theta iota kappa\n\nx y x"), (2, "alpha " * 3000)]
    for i in range(10, 90):
        base = rng.choice([t for ts in templates.values() for t in ts]).split() * rng.choice([1, 1, 2])
        for _ in range(rng.randint(0, 4)):
            base.insert(rng.randrange(len(base)), rng.choice([*words, "\n", "\n\n"]))
        rows.append((i, " ".join(base)))
    want = []
    for i, t in rows:
        lines = [re.findall("[a-z0-9]+", x) for x in (t or "").lower().split("\n")]
        plain = "\n".join(" ".join(x) for x in lines).strip("\n")
        units = {" ".join(plain.split())}
        for parts in (re.split("\n+", plain), re.split("\n\n+", plain)):
            units |= {" ".join(" ".join(parts[p : p + k]).split()) for k in (1, 2, 3) for p in range(len(parts) - k + 1)}
        found = []
        for u in units:
            grams = lambda w: set(zip(w, w[1:]))
            n = grams(u.split())
            for name, ts in templates.items():
                for m in (grams(x.split()) for x in ts):
                    d = 2 * len(n & m) / (len(n) + len(m))
                    if 100 * d >= 80 - 1e-9:
                        found.append((-d, name))
        best = min(found, default=(None, None))
        want.append((str(i), ",".join(sorted({x for _, x in found})), str(best[1]), best[0] and round(-best[0], 9)))
    got = [(str(r.doc_id), ",".join(r.licenses), str(r.best_license), r.best_dice and round(r.best_dice, 9)) for r in license_scan.scan_licenses(frame(spark, rows), templates=templates).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({x[1] for x in want}) > 3


def test_fitting_takes_one_text_an_id(spark):
    docs = spark.createDataFrame([(3, f"text {i}") for i in range(40)] + [(3, "text 1"), (4, "a"), (None, "b"), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (8, 1), (None, 1)], "doc_id long, quality int")
    rows = quality_classifier.fit_rows(docs, labels, "quality", 10**6, 5).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 2 and {r.doc_id: r.label for r in rows} == {3: 1, 4: 0}
    assert quality_classifier.fit_rows(docs, labels, "quality", 10**6, 1).count() <= 1


def fill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, left = sum(sizes.values()), {}, set(names)
    while left:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
        left -= over
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(0, 80)), rng.choice(["a", "a", "a", "b", "é", None, "z"])) for i in range(400)] + [(900, None, "a"), (901, "", "empty"), (7, "x y", "a"), (None, "k k", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs.withColumns({"size": F.lit("c"), "taken": F.lit(1)}), keep=()).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(spaced(t))
    want = fill(size)
    by = {r.source_size: s for s in size for r in got if size[s] == r.source_size}
    taken, big = Counter(), Counter()
    src = {i: s for i, _, s in rows}
    for r in got:
        assert r.taken <= 3 * r.size and math.isclose(r.target, want[by[r.source_size]], rel_tol=1e-9, abs_tol=1e-9)
        taken[src[r.doc_id]] += r.taken
        big[src[r.doc_id]] = max(big[src[r.doc_id]], r.size)
    for s in size:
        if s in ("b", None) or s == "a":  # a repeated or missing id is one unit
            assert abs(taken[s] - want[s]) <= 2 * big[s]
        else:
            assert abs(taken[s] - want[s]) <= big[s] / 2 + 1e-9
    assert mixing.mix(docs.where("false")).count() == 0
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r.copies for r in got)


def test_mixing_by_salted_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 9), "ab"[i % 2]) for i in range(80)], "doc_id long, text string, source string")
    once = sorted(tuple(r) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(tuple(r) for r in mixing.mix(docs).collect()) == once


def test_sharding(spark):
    rows = corpus(4, 300)
    docs = frame(spark, rows)
    store = sharding.shard(docs, new_dir(spark, "t"), target_bytes=40_000)
    back = store.read()
    assert back.columns == docs.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    runs = store.manifest()["runs"]
    tiers = Counter(store.tier(r["bytes"]) for r in runs)
    assert sum(n for t, n in tiers.items() if t >= 0) <= 1 and any(r["level"] for r in runs)
    assert sharding.placed(store).count() == len(rows)
    with pytest.raises(sharding.Conflict):
        store.commit(store.manifest(), store.version() - 1)
    before = store.version()
    store.append(docs.limit(3))
    assert store.version() == before + 1 and store.read().count() == len(rows) + 3 and store.read(before).count() == len(rows)
    assert sharding.placed(sharding.shard(frame(spark, []), new_dir(spark, "t"))).count() == 0


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(5, 5), (None, 1), (3, 2)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("k", "percent", "common"), [(4, 85, 16), (5, 80, 2)])
def test_jaccard(spark, k, percent, common):
    rows = corpus(6, 80) + [(None, "solo"), (None, "only here"), (3, corpus(6, 80)[4][1])]
    sets = []
    for i, t in rows:
        w = spaced(t)
        sets.append({tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    least = {}
    for j, (i, _) in enumerate(rows):
        if i is not None:
            least[root(j)] = min(i, least.get(root(j), i))
    want = sorted(str((i, len(s), least.get(root(j)) if s else i)) for j, ((i, _), s) in enumerate(zip(rows, sets)))
    got = jaccard_join.similar_classes(frame(spark, rows), k, percent, common_from=common).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert jaccard_join.similar_classes(frame(spark, []), k, percent).count() == 0


def test_quality_rules(spark):
    junk = "Home | About | Contact | Blog | Help\n" * 3
    good = "\n".join(" ".join(f"word{i * j}" for j in range(12)) + "." for i in range(1, 8))
    rows = corpus(8, 30) + [(200, good), (201, good + "\n" + junk), (202, junk * 9), (203, "WE SHOUT!! " * 30), (204, "a\nb b\nb b\n\n\nc"), (205, good + "\nAll rights reserved by us\n")]
    got = {}
    for r in quality_rules.clean_lines(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines, seen, dup = (t or "").split("\n"), set(), 0
        for x in lines:
            if x.split():
                dup += x in seen
                seen.add(x)
        runs = Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7)) if len(w) < 2000 else None
        rep = set()
        if runs is not None:
            for p in range(len(w) - 7):
                if runs[tuple(w[p : p + 8])] > 1:
                    rep |= set(range(p, p + 8))
        n_rep = len(rep) if runs is not None else len(w)
        for r in got[i]:
            base = len(w) < 20 or 100 * n_rep > 30 * len(w)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, n_rep, base), i
            assert not (base and r.kept)
    assert got[200][0].kept and got[201][0].kept and got[201][0].clean_text == good + "\n" and not got[202][0].kept and not got[203][0].kept
    assert got[205][0].clean_text == good + "\n"
    assert quality_rules.clean_lines(frame(spark, [])).count() == 0


def test_chat(spark):
    odd = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "tool", None), (1, 3, None, "\\[INST]"), (2, 5, "system", "s"), (2, 1, "user", ""), (2, 1, "user", ""), (2, None, "assistant", "late"), (None, 1, "user", "x")] + [(3, i, ["user", "assistant"][i % 2], f"t{i} </s>") for i in range(300)]
    conv = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(conv)).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars, r.rewritten) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat_format.inst_template(turns)), False)
    assert chat_format.digests(chat_format.format_turns(conv.where("false"))).count() == 0


def test_a_template_that_rewrites_is_reported():
    def last_only(turns):
        return "".join(f"<{r}>" + (t if i == len(turns) - 1 else "...") for i, (r, t) in enumerate(turns))

    assert [x[-1] for x in chat_format.spans_of(last_only, iter([("user", "a"), ("assistant", "b")]))] == [False, True]


def test_lm(spark):
    rows = corpus(10, 120) + [(400 + i, " ".join(random.Random(i).choices(["Le", "la", "les", "maison", "maisons", "w1", "q\x01z"], k=30))) for i in range(40)] + [(None, "le la")]
    got = lm_score.train_and_score(frame(spark, rows), top=8).collect()
    count, held = Counter(), lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    for i, t in rows:
        if not held(i):
            count.update([*spaced(t), "\n"])
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(w := [*spaced(t), "\n"]), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 5)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    short = [r for r in got if r.n_tokens < 200 and not r.held_out]
    assert sum(r.score for r in short) > 1.2 * sum(r.base_score for r in short)
    assert lm_score.train_and_score(frame(spark, [])).count() == 0


def labelled(spark, name, seed=11):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(240):
        bad = rng.random() < 0.3
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randint(0, 99)) for _ in range(40)) + "."
        if bad:
            text = text.upper().replace(" ", "!! ") if name == "quality" else text + rng.choice([" you idiot and moron", " worthless trash", " pathetic loser, stupid"])
        rows.append((i, text))
        labels.append((i, int(not bad) if name == "quality" else int(bad)))
    rows += [(500, None), (501, ""), (None, "alpha"), (7, rows[7][1]), (502, "x " * 20_000)]
    labels += [(None, 1), (3, None)]
    return frame(spark, rows), spark.createDataFrame(labels, f"doc_id long, {name} int"), dict(labels), len(rows)


@pytest.mark.parametrize(("name", "run", "cut"), [("quality", quality_classifier.score_quality, 0.3), ("toxic", toxicity.score_toxicity, 0.5)])
def test_classifiers(spark, name, run, cut):
    docs, labels, known, n = labelled(spark, name)
    got = run(docs, labels).collect()
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and known.get(r.doc_id) is not None]
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.95 * len(held)
    assert len(run(docs, labels.where("false")).collect()) == n
    assert run(docs.where("false"), labels).count() == 0
