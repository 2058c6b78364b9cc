"""The parallel reader of JSON lists against json itself, in one block and in many."""

import json
import random

import pytest

from siltstone.sources import json_array, tables


@pytest.fixture
def blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": None}
    before = {k: spark.conf.get(k, None) for k in keys}

    def of(size, parts):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(1, -(-size // parts))))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield of
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def value(rng, depth=0):
    k = rng.randint(0, 6)
    if k == 0:
        return "".join(rng.choice('ab"\\{}[],é\n:') for _ in range(rng.randint(0, 12)))
    if k == 1:
        return rng.randint(-5, 10**6)
    if k == 2 and depth < 3:
        return {f"k{i}": value(rng, depth + 1) for i in range(rng.randint(0, 3))}
    if k == 3 and depth < 3:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, 1.5, "}", "\\", '\\"'])


@pytest.mark.parametrize("seed, n", [(0, 0), (1, 1), (2, 2), (3, 60), (4, 300)])
def test_lists_of_any_objects(spark, tmp_path, blocks, seed, n):
    rng = random.Random(seed)
    objects = [{"id": i, "s": json.dumps(value(rng))} | ({"other": value(rng)} if rng.random() < 0.5 else {}) for i in range(n)]
    path = tmp_path / "f.json"
    path.write_text(" \n" * (seed % 2) + json.dumps(objects, ensure_ascii=seed % 2 == 0, indent=2 if seed % 3 else None) + "\n" * (seed % 2))
    for parts in (1, 7, 32):
        blocks(path.stat().st_size, parts)
        got = json_array.read_json_array(spark, str(path), "id long, s string")
        assert sorted((r.id, r.s) for r in got.collect()) == [(o["id"], o["s"]) for o in objects]


BAD = {
    '[{"a":1}, 5, {"a":2}]': "element 2", "[1]": "element 1", '[{"a":1} {"a":2}]': "element 2", '["}", {"a":1}]': "element 1", '[[{"a":1}]]': "element 1",
    '[{"a":1},]': "element 2", '[{"a":1}] x': "element 2", '{"a":1}': "no JSON list", '[{"a":1}': "not closed", '[{"a":1}]]': "no JSON list", '[{"a":"x}': "not closed",
}


@pytest.mark.parametrize("text", BAD)
def test_what_is_no_list_of_objects_is_named(spark, tmp_path, blocks, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    for parts in (1, 5):
        blocks(len(text), parts)
        with pytest.raises(Exception, match=BAD[text]):
            json_array.read_json_array(spark, str(path), "a int").collect()


def test_documents_in_one_file(spark, tmp_path, blocks):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tables.write_json_list(docs, str(tmp_path / "l"), "doc_id", one_file=True)
    size = max(p.stat().st_size for p in (tmp_path / "l").glob("part-*"))
    for parts in (1, 32):
        blocks(size, parts)
        got = tables.read_records(spark, str(tmp_path / "l"), docs.schema)
        assert got.exceptAll(docs).count() == 0 and got.count() == docs.count()
        assert json_array.elements(spark, str(tmp_path / "l")).selectExpr("min(n)", "max(n)", "count(distinct n)").first() == (0, docs.count() - 1, docs.count())
