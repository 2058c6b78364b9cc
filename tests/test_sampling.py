import hashlib
import random

import pytest

from siltstone.operators import sampling


def draw(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def one_by_one(rows, total, seed=42):
    """Buckets in order, then all rows, each row in turn."""
    buckets = sorted({r[1] for r in rows})
    quota, left, turn = dict.fromkeys(buckets, 0), total, 0
    while left and turn <= len(rows):
        turn += 1
        for x in buckets:
            if left and sum(r[1] == x for r in rows) >= turn:
                quota[x] += 1
                left -= 1
    seen, out = set(), []
    for x in buckets:
        n = 0
        for k, _, d in sorted((r for r in rows if r[1] == x), key=lambda r: draw(seed, r[0])):
            if n < quota[x] and d not in seen:
                seen.add(d)
                out.append(k)
                n += 1
    for k, _, d in sorted(rows, key=lambda r: draw(seed + 1, r[0])):
        if len(out) < total and d not in seen:
            seen.add(d)
            out.append(k)
    return out


@pytest.mark.parametrize("total", [1, 7, 20, 29])
def test_diverse_is_the_sequential_rule(spark, total):
    rng = random.Random(total)
    rows = [(f"r{i}", rng.choice("aaabc"), f"d{rng.randrange(40)}") for i in range(120)]
    want = one_by_one(rows, total)
    df = spark.createDataFrame(rows, "id string, bucket string, diversity string")
    assert len(want) == total
    assert sorted(r.id for r in sampling.diverse(df, "bucket", "diversity", "id", total).collect()) == sorted(want)


def test_diverse_stops_when_short(spark):
    df = spark.createDataFrame([("x", "a", "d"), ("y", "b", "d")], "id string, bucket string, diversity string")
    with pytest.raises(ValueError, match="1 found"):
        sampling.diverse(df, "bucket", "diversity", "id", 2)
