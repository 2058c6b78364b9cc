"""The model surface: batches, retries, rows that fail alone, and runs that score what is missing."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import scoring
from siltstone.sources import images


def test_a_failing_row_fails_alone():
    calls = []

    def call(rows):
        calls.append(len(rows))
        if any(r["x"] == 5 for r in rows):
            raise RuntimeError("no")
        return [{"y": r["x"]} for r in rows]

    out = scoring.attempt(call, [{"x": i} for i in range(8)], 2, 0.0)
    assert [isinstance(x, RuntimeError) for x, _ in out] == [i == 5 for i in range(8)] and out[5][1] == 2
    assert calls[:2] == [8, 8] and max(calls[2:]) == 4


def test_retries_end_when_a_call_succeeds():
    left = [2]

    def call(rows):
        left[0] -= 1
        if left[0] >= 0:
            raise OSError("busy")
        return [{}] * len(rows)

    assert scoring.attempt(call, [{}, {}], 3, 0.0) == [({}, 3), ({}, 3)]


def model(planted):
    def load():
        import os

        pid = os.getpid()

        def call(rows):
            assert len(rows) <= 4
            if any(r["id"] in planted for r in rows):
                raise RuntimeError("planted")
            return [ValueError("refused") if r["id"] == 3 else {"pid": pid, "n": "many" if r["id"] == 4 else r["id"]} for r in rows]

        return call

    return load


def test_results_reasons_and_batches(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(30)] + [(None, None), (8, "again")], "id long, reason_ string").repartition(2)
    got = scoring.score(df, ["id"], model({11, 12}), "n long, pid long", rows=4, tries=2).collect()
    assert len(got) == 32 and len({r.pid for r in got if r.pid}) <= 4
    for r in got:
        want = "RuntimeError: planted" if r.id in (11, 12) else "ValueError: refused" if r.id == 3 else "Arrow" if r.id == 4 else None
        assert (r.reason is None) == (want is None) and (want is None or want in r.reason), r
        assert r.n == (r.id if want is None else None)
    assert scoring.score(df.limit(0), ["id"], model(()), "n long, pid long").collect() == []


def test_a_second_run_scores_what_is_missing(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)] + [(None, "no key"), (5, "t5")], "id long, text string")
    sink, dead = str(tmp_path / "scores"), str(tmp_path / "dead")
    how = {"rows": 4, "tries": 1}
    first = scoring.score_missing(df, "id", model({7, 8}), "n long, pid long", sink, dead, ["id", "text"], 1, **how)
    assert first == {"asked": 20, "scored": 16, "failed": 4}
    second = scoring.score_missing(df, "id", model({8}), "n long, pid long", sink, dead, ["id", "text"], 2, **how)
    assert second == {"asked": 4, "scored": 1, "failed": 3}
    got = spark.read.parquet(sink)
    assert got.count() == 17 and {(r.id, r.run) for r in got.collect()} == {(i, 2 if i == 7 else 1) for i in range(20) if i not in (3, 4, 8)}
    letters = spark.read.json(dead)
    assert letters.count() == 7 and letters.where("payload = '{\"id\":8,\"text\":\"t8\"}'").count() == 2
    assert scoring.score_missing(df.where("id > 8"), "id", model(()), "n long, pid long", sink, dead, ["id"], 3, **how)["asked"] == 0


def test_images_go_through_in_batches(spark):
    rows = [(f"i{k}", k, f"n{k}.png", b"x" * k if k else None) for k in range(9)]
    df = spark.createDataFrame(rows, "image string, case_id long, name string, content binary").coalesce(1)

    def load():
        def tagger(contents):
            if any(len(c) == 6 for c in contents):
                raise RuntimeError("unreadable")
            return [[("dent", len(c) / 10), ("dent", 0.9), (f"of{len(contents)}", 0.0)] for c in contents]

        return tagger

    got = {r.image: r for r in images.tag_batches(df, load, 0.5, rows=4).collect()}
    assert got["i6"].reason == "RuntimeError: unreadable" and got["i6"].damage_types is None
    assert got["i0"].raw == [] and got["i0"].reason is None
    assert all(got[f"i{k}"].damage_types == ["dent"] for k in (1, 2, 5, 8)) and got["i1"].raw[2].tag == "of3"
    with pytest.raises(Exception, match="unreadable"):
        images.tag_images(df, lambda c: load()([c])[0], 0.5).select(F.sum(F.size("raw"))).collect()
