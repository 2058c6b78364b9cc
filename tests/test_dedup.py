import random

import pytest

from siltstone.operators import dedup


def greedy(rows):
    ids, fps, out = set(), set(), {}
    for pos, i, fp in rows:
        if i and i in ids:
            out[pos] = "id_duplicate"
        elif fp in fps:
            out[pos] = "fp_duplicate"
        else:
            out[pos] = "kept"
            ids.add(i)
            fps.add(fp)
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "pos long, id string, fp string")
    return {r.pos: r.outcome for r in dedup.greedy_dedup(df).collect()}


def test_small_cases(spark):
    for rows, kept in (
        ([(1, "a", "x"), (2, "b", "x"), (3, "b", "z")], {1, 3}),
        ([(1, "a", "x"), (2, "a", "y"), (3, "c", "y")], {1, 3}),
        ([(1, "", "x"), (2, "", "y")], {1, 2}),
        ([(1, None, "x"), (2, "", "x")], {1}),
    ):
        assert {k for k, v in run(spark, rows).items() if v == "kept"} == kept


def test_greedy_is_the_sequential_rule(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["", *"abcdefgh"]), rng.choice("stuvwxyz")) for i in range(60)]
    assert run(spark, rows) == greedy(rows)


def test_no_rows(spark):
    assert run(spark, []) == {}


def test_near_duplicates(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [rng.choices(words, k=30) for _ in range(3)]
    sets = []
    for i in range(40):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(30)] = rng.choice(words)
        sh = list(dict.fromkeys(" ".join(t[j : j + 3]) for j in range(28)))
        sets.append((i, rng.choice("xy"), [] if i == 7 else sh))
    df = spark.createDataFrame(sets, "id long, grp string, sh array<string>")

    def sim(a, b):
        a, b = set(a), set(b)
        return bool(a and b) and len(a & b) / len(a | b) >= 0.82

    kept, out = [], {}
    for i, g, sh in sets:
        out[i] = not any(g == g2 and sim(sh, s2) for _, g2, s2 in kept)
        if out[i]:
            kept.append((i, g, sh))
    assert {r.id: r.kept for r in dedup.near_duplicates(df).collect()} == out


def jaccard(a, b):
    words = lambda t: [w for w in "".join(c if c.isascii() and (c.isalnum() or c in "<>") else " " for c in t.lower()).split()]
    sh = lambda w: {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    a, b = sh(words(a)), sh(words(b))
    return len(a & b) / len(a | b) if a and b else 0


def claims_in_order(statements, threshold=0.82):
    kept, out = [], {}
    for pos in sorted({s[0] for s in statements}, key=lambda p: (not any(s[3] for s in statements if s[0] == p), p)):
        own = [s for s in statements if s[0] == pos]
        out[pos] = own[0][3] or not any(s[1] == k[1] and jaccard(s[2], k[2]) >= threshold for s in own for k in kept)
        if out[pos]:
            kept += own
    return out


@pytest.mark.parametrize("remainder", [0, 100_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_claims_of_several_statements(spark, monkeypatch, remainder, seed):
    monkeypatch.setattr(dedup, "REMAINDER", remainder)
    rng = random.Random(seed)
    base = [rng.choices([f"w{i}" for i in range(60)], k=24) for _ in range(6)]
    rows = []
    for pos in range(70):
        before = rng.random() < 0.15
        for _ in range(rng.randint(1, 3)):
            t = list(rng.choice(base)) if rng.random() < 0.6 else rng.choices([f"v{i}" for i in range(400)], k=24)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(24)] = rng.choice(["zz", "yy"])
            rows.append((pos, rng.choice("ab"), " ".join(t) if rng.random() < 0.95 else rng.choice(["", "?", "one"]), before))
    got = dedup.claim_rejects(spark.createDataFrame(rows, "pos long, role string, text string, before boolean"))
    assert {r.pos: r.kept for r in got.collect()} == claims_in_order(rows)


def test_a_long_chain_is_settled_in_order(spark):
    n = 3000
    members = spark.range(n).selectExpr("id as pos", "string(id) as cls", "false as before")
    links = spark.range(n - 1).selectExpr("string(id) as a", "string(id + 1) as b")
    assert sorted(r.pos for r in dedup.greedy_rejects(members, links).collect()) == list(range(1, n, 2))
    rows = [(i, f"i{(i + 1) // 2}", f"f{i // 2}") for i in range(n)]
    assert run(spark, rows) == greedy(rows)


@pytest.mark.parametrize("remainder", [0, 7])
def test_rounds_alone_give_the_sequential_rule(spark, monkeypatch, remainder):
    monkeypatch.setattr(dedup, "REMAINDER", remainder)
    rng = random.Random(4)
    rows = [(i, rng.choice(["", *"abcdefgh"]), rng.choice("stuvwxyz")) for i in range(40)]
    assert run(spark, rows) == greedy(rows)


def all_pairs(rows):
    """{(id_a, id_b): (common, total)} of rows (id, grp, words) by loops: classes of equal sets, by their first id."""
    first = {}
    for i, g, ws in rows:
        sh = frozenset(tuple(ws[j : j + 3]) for j in range(max(1, len(ws) - 2))) if ws else None
        if sh and g is not None:
            first.setdefault((g, sh), i)
    own = sorted((i, g, sh) for (g, sh), i in first.items())
    return {(i, j): (len(x & y), len(x | y)) for i, g, x in own for j, g2, y in own if i < j and g == g2 and len(x & y) >= 0.82 * len(x | y) - 1e-9}, {i for i, _, _ in own}


def texts_of_many_copies(seed):
    rng = random.Random(seed)
    base = [rng.choices([f"w{i}" for i in range(60)], k=40) for _ in range(3)]
    rows = []
    for i in range(120):
        ws = list(rng.choice(base)) if i % 4 else rng.choices(["a", "b", "c<", "d9"], k=rng.randint(0, 4))
        for _ in range(rng.randint(0, 2) if len(ws) == 40 else 0):
            ws[rng.choice([0, 1, 38, 39, 20])] = rng.choice(["zz", "yy", "w1"])
        rows.append((i, rng.choice(["x", "x", "y", None]), ws))
    return rows


@pytest.mark.parametrize("long", [2, 256])
@pytest.mark.parametrize("seed", [1, 2])
def test_texts_are_joined_without_stored_sets(spark, monkeypatch, seed, long):
    monkeypatch.setattr(dedup, "LONG", long)  # 2: kept rows are found by lists' first rows
    rows = texts_of_many_copies(seed)
    want, firsts = all_pairs(rows)
    df = spark.createDataFrame([(i, g, ".,- "[i % 4].join(ws)) for i, g, ws in rows], "id long, grp string, sh string")
    settled, real = [], dedup.settle
    monkeypatch.setattr(dedup, "settle", lambda x, name: settled.append(x.columns) or real(x, name))
    got = dedup.similar_sets(df).collect()
    assert {(r.id_a, r.id_b): (r.common, r.total) for r in got} == want and len(got) == len(want) > 50
    grp = {i: g for i, g, _ in rows}
    assert all(r.grp == grp[r.id_a] for r in got)
    kept = set()
    for i in sorted(firsts):
        if not any((k, i) in want for k in kept):
            kept.add(i)
    nulls = {}
    for i, g, ws in rows:
        if g is None and ws:
            nulls.setdefault(frozenset(tuple(ws[j : j + 3]) for j in range(max(1, len(ws) - 2))), i)
    kept |= set(nulls.values()) | {i for i, _, ws in rows if not ws}
    assert {r.id for r in dedup.near_duplicates(df).collect() if r.kept} == kept
    assert settled and not any({"sh", "text"} & set(c) for c in settled)
