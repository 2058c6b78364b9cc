import json

import pytest

from siltstone.sources import images, tables
from siltstone.streaming.incremental import resume_stream

KIND = "id string, n int"


def test_json_files(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.jsonl"
    a.write_text(json.dumps([{"id": "x", "n": 1}, {"id": "y", "n": 2}]))
    b.write_text('{"id": "x", "n": 1}\n\n{"id": "é", "n": null}\n')
    assert tables.read_records(spark, str(a), KIND).count() == 2
    assert [tuple(r) for r in tables.read_records(spark, str(b), KIND).collect()] == [("x", 1), ("é", None)]


def test_bad_lines(spark, tmp_path):
    p = tmp_path / "b.jsonl"
    p.write_text('{"id": "x", "n": 1}\nnonsense\n')
    with pytest.raises(Exception):
        tables.read_jsonl(spark, str(p), KIND).collect()
    assert tables.read_jsonl(spark, str(p), KIND, strict=False).count() == 2


def test_csv_and_append(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x",\nok'), ("b", None)], "id string, text string")
    tables.write_csv(df, str(tmp_path / "c"))
    back = {r.id: r.text for r in tables.read_csv(spark, str(tmp_path / "c"), "id string, text string", ["text"]).collect()}
    assert back == {"a": 'say "x",\nok', "b": ""}
    for _ in range(2):
        tables.append_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4


def test_numbered_and_json_list(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as id")
    assert all(r["_n"] == r.id for r in tables.numbered(df, "id").collect())
    assert tables.numbered(df.where("false"), "id").count() == 0
    rows = json.loads(tables.json_list(spark.createDataFrame([(2, "b"), (1, "a")], "n int, s string"), "n").first().value)
    assert rows == [{"n": 1, "s": "a"}, {"n": 2, "s": "b"}]


def test_bad_lines_are_numbered(spark, tmp_path):
    rows = [json.dumps({"id": str(i), "n": i}) for i in range(3000)]
    rows[1233], rows[2000], rows[2500] = "[1]", "", "{broken"
    (tmp_path / "b.jsonl").write_text("\n".join(rows) + "\n")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        at = str(tmp_path / "b.jsonl")
        assert sorted((r.line, r.value) for r in tables.bad_lines(spark, at).collect()) == [(1234, "[1]"), (2501, "{broken")]
        with pytest.raises(ValueError, match="line 1234"):
            tables.require_objects(spark, at)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    (tmp_path / "ok.jsonl").write_text(rows[0] + "\n\n")
    tables.require_objects(spark, str(tmp_path / "ok.jsonl"))


def test_responses_are_appended(spark, tmp_path):
    at = str(tmp_path / "kept")
    assert tables.read_appended(spark, at, KIND).count() == 0
    texts = spark.createDataFrame([('[{"id": "a", "n": 1}, {"id": "b"}]',), ('{"id": "c", "n": 3}',), ("no JSON",), (None,)], "r string")
    tables.append_json(tables.response_records(texts, "r", "id string, n int"), at)
    (tmp_path / "kept" / "part-x.json").write_text("{broken\n")
    assert sorted(r.id for r in tables.read_appended(spark, at, KIND).collect()) == ["a", "b", "c"]


def test_stats_and_dead_letters(spark, tmp_path):
    tables.write_stats(spark, {"rows": 3, "where": "é"}, str(tmp_path / "new" / "stats.json"))
    assert json.loads((tmp_path / "new" / "stats.json").read_text()) == {"rows": 3, "where": "é"}
    failed = spark.createDataFrame([("no JSON", "ask", "answer")], "reason string, prompt string, response string")
    for _ in range(2):
        tables.write_dead_letters(failed, str(tmp_path / "dead"))
    back = spark.read.json(str(tmp_path / "dead")).collect()
    assert len(back) == 2 and {(r.reason, r.prompt, r.response) for r in back} == {("no JSON", "ask", "answer")}
    assert all(r.failed_at for r in back)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_json_list_in_parts(spark, tmp_path, n):
    df = spark.range(n).selectExpr("id * 7 % 500 as n", "concat('s', id) as s")
    tables.write_json_list(df, str(tmp_path / "l"), "n", "s")
    whole = "".join(p.read_text() for p in sorted((tmp_path / "l").glob("part-*")))
    assert json.loads(whole) == [{"n": r.n, "s": r.s} for r in sorted(df.collect())]
    tables.write_jsonl(df, str(tmp_path / "j"), one_file=True)
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "j").glob("part-*")) == n


def test_images(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"dent dent glass")
    (tmp_path / "b.jpg").write_bytes(b" ")
    from pyspark.sql import functions as F

    def tagger(content):
        return [(w.decode(), 0.2 if w == b"glass" else 0.9) for w in content.split()]

    found = images.read_images(spark, str(tmp_path / "*.jpg")).withColumn("case_id", F.lit(4))
    rows = {r.file_path: r for r in images.tag_images(found, tagger, 0.5).collect()}
    assert rows["uploads/case_4_a.jpg"].damage_types == ["dent"] and len(rows["uploads/case_4_a.jpg"].raw) == 3
    assert rows["uploads/case_4_b.jpg"].damage_types == []
    cases = spark.createDataFrame([(4, ["crack"]), (5, None), (6, [])], "case_id int, detected_damages array<string>")
    new = spark.createDataFrame([(4, 2, ["hole", "crack"]), (4, 1, ["dent"]), (6, 0, ["dent"])], "case_id int, position int, damage_types array<string>")
    assert {r.case_id: r.detected_damages for r in images.merge_damages(cases, new).collect()} == {4: ["crack", "dent", "hole"], 5: None, 6: ["dent"]}


def test_stream_resumes(spark, tmp_path):
    src, sink, check = (str(tmp_path / x) for x in ("src", "sink", "check"))
    schema = spark.createDataFrame([], KIND).schema
    for rows in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]):
        spark.createDataFrame(rows, KIND).write.mode("append").parquet(src)
        resume_stream(spark, src, sink, check, schema, "id").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]
