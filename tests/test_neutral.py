"""Neutral pairs up to a target against drawing them one by one."""

import hashlib
import random

import pytest

from siltstone.operators import pairs
from siltstone.sources import tables


def one_by_one(rows, n, seed=42):
    md5 = lambda x: hashlib.md5(f"{seed}:{x}".encode()).hexdigest()
    pool = sorted((r for r in rows if r[2] and r[3]), key=lambda r: (md5(r[0]), r[0]))
    size, shift, seen, out, t = len(pool), int(md5("shift")[:8], 16), set(), [], 0
    while len(out) < n and t < max(50 * n, 1000) and size > 1:
        a, b = pool[t % size], pool[(t % size + 1 + (t // size + shift) % (size - 1)) % size]
        key = frozenset((a[3], b[3]))
        if a[1] != b[1] and key not in seen:
            seen.add(key)
            out.append((a[0], b[0]))
        t += 1
    return out


@pytest.fixture
def rows():
    rng = random.Random(2)
    return [(f"s{i}", f"c{rng.randrange(9)}", rng.choice(["a", "b", "b", ""]), rng.choice(["", *(f"text {k}" for k in range(25))])) for i in range(60)]


@pytest.mark.parametrize("n", [0, 5, 40, 200])
def test_as_drawn_one_by_one(spark, rows, n):
    want = one_by_one(rows, n)
    for parts in (4, 37):
        df = spark.createDataFrame(rows, "id string, claim_id string, role string, text string").repartition(parts)
        got = pairs.neutral_sample(df, n).collect()
        assert [(r.id_a, r.id_b) for r in sorted(got, key=lambda r: r.pair_id)] == want and len(want) == n
        assert sorted(r.pair_id for r in got) == [f"NEUTRAL-{i + 1:06d}" for i in range(n)]


def test_too_few_pairs_are_an_error(spark, rows):
    df = spark.createDataFrame(rows, "id string, claim_id string, role string, text string")
    with pytest.raises(RuntimeError, match="of 400 neutral pairs"):
        pairs.neutral_sample(df, 400).collect()
    for few in (df.limit(0), df.where("claim_id = 'c1'")):
        with pytest.raises(RuntimeError, match="0 of 1 neutral pairs"):
            pairs.neutral_sample(few, 1)


def test_sources_that_fail_are_skipped_and_named(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "corrupt.json").write_text('[{"a": 1}, {"a": ]')
    (tmp_path / "lines.jsonl").write_text('{"a": 3, "b": 4}\n')
    read = lambda name, kind="a long": lambda: tables.read_records(spark, str(tmp_path / name), kind)
    rows, report = tables.load_sources(spark, {"good": read("good.json"), "missing": read("none.json"), "corrupt": read("corrupt.json"), "lines": read("lines.jsonl", "a long, b long")})
    assert sorted((r.a, r.b, r.origin) for r in rows.collect()) == [(1, None, "good"), (2, None, "good"), (3, 4, "lines")]
    got = {r.source: (r.n, r.reason) for r in report.collect()}
    assert got["good"] == (2, None) and got["lines"] == (1, None) and "PATH_NOT_FOUND" in got["missing"][1] and got["corrupt"][0] is None and got["corrupt"][1]
    rows, report = tables.load_sources(spark, {"missing": read("none.json")})
    assert rows is None and report.count() == 1
