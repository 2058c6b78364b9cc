"""Readers, writers and the shared folder."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.sources.json_array import read_json_array


#: Temporary folders of local applications.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder in local
    mode, in which all is one process; an error on a cluster. No setting is changed."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not at:
        at = _OWN.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="siltstone-"))
    return at.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, partitions: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and no executor's loss undoes it."""
    spark, at = df.sparkSession, new_dir(df.sparkSession, name)
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(at)
    return spark.read.schema(schema).parquet(at)


def drop_settled(*frames: DataFrame) -> None:
    """Removes the files of settled tables that are not needed any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """A JSON object a line, blank lines skipped. A bad line stops the query, or, not strict, gives a row of nulls;
    bad_lines says where they are."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines, numbered from 1 in their file, that are not blank and no JSON object. Lines are
    counted by block of a file, so no file is read in one piece and only blocks' counts are put in order."""
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(path).select("value", *at, F.monotonically_increasing_id().alias("m"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    blocks = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    kind = F.schema_of_variant(F.try_parse_json("value"))
    bad = lines.where((F.trim("value") != "") & ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)))
    return bad.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("m") - F.col("first") + 1).alias("line"), "value")


def require_objects(spark: SparkSession, path: str) -> None:
    """Raises ValueError with file and number of the first line that is no JSON object."""
    first = bad_lines(spark, path).agg(F.min(F.struct("file", "line")).alias("f")).first().f
    if first is not None:
        raise ValueError(f"no JSON object at line {first.line} in {first.file}")


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """By suffix: .jsonl is a line each, everything else a JSON list."""
    return read_jsonl(spark, path, schema) if path.endswith(".jsonl") else read_json_array(spark, path, schema)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, texts: list[str]) -> DataFrame:
    """A CSV file with a header; missing texts are empty."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("", subset=texts)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_jsonl(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Adds rows as further files; those that are there stay as they are."""
    df.write.mode("append").json(path)


def read_appended(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What append_json wrote. A path that is not there is empty, and so is a line that is no JSON."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def response_records(df: DataFrame, response: str, schema: str) -> DataFrame:
    """Rows of the objects (a struct's fields by `schema`) in texts that are a JSON list of them or one object, which
    counts as a list of one; other texts have none."""
    found = F.from_json(F.col(response), f"array<struct<{schema}>>")
    return df.select(F.inline(F.filter(found, lambda x: x.isNotNull())))


def write_stats(spark: SparkSession, stats: dict, path: str) -> None:
    """A small JSON file beside a job's outputs, in whatever file system the path names; folders are made."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    try:
        out.write(bytearray(json.dumps(stats, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()


#: Rows that json_list puts into one value.
LIST_ROWS = 100_000


def json_list(df: DataFrame, order: str) -> DataFrame:
    """A small table's rows as one JSON list; more than LIST_ROWS are refused: write_json_list takes any number."""
    if df.limit(LIST_ROWS + 1).count() > LIST_ROWS:
        raise ValueError(f"more than {LIST_ROWS} rows in one value; write_json_list writes them in parts")
    return df.groupBy().agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*df.columns).alias("r")))), lambda x: x["r"])).alias("value"))


def write_json_list(df: DataFrame, path: str, *order: str, one_file: bool = False) -> None:
    """Text files that, one after another by name, are one JSON list of the rows in order; no rows are an empty list.
    one_file: a single file, which one task writes."""
    rows = numbered(df, *order, name="_n")
    last = rows.agg(F.max("_n")).first()[0]
    if last is None:
        df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    value = F.concat(F.when(F.col("_n") == 0, "[").otherwise(""), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), F.when(F.col("_n") == last, "]").otherwise(","))
    listed = rows.select("_n", value.alias("value"))
    (listed.repartition(1) if one_file else listed.repartitionByRange("_n")).sortWithinPartitions("_n").select("value").write.mode("overwrite").text(path)


def last_by_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """Of each key's rows the one with the last position."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), position).alias("r")).select(key, "r.*")


def numbered(df: DataFrame, *order: str, name: str = "_n", start: int = 0) -> DataFrame:
    """Rows numbered in order without meeting in one task: range partitions are counted, and each numbers its own rows
    after the rows of those before it. The columns of `order` must tell rows apart for reruns to agree."""
    spread = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    before, offsets = start, []
    for r in sorted(spread.groupBy("_part").agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: r["_part"]):
        offsets.append((r["_part"], before))
        before += r["c"]
    if not offsets:
        return spread.drop("_part").withColumn(name, F.lit(0).cast("long"))
    known = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return spread.join(F.broadcast(known), "_part").withColumn(name, (F.col("_before") + own).cast("long")).drop("_part", "_before")


def running(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """df with, for each (name: column), the sum of the column over all rows up to and with each, in order; no rows meet in
    one task: range partitions are summed, and each adds up its own rows on top of those before it."""
    spread = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    before, offsets = [0] * len(sums), []
    for r in sorted(spread.groupBy("_part").agg(*[F.sum(c).alias(k) for k, c in sums.items()]).collect(), key=lambda r: r["_part"]):
        offsets.append((r["_part"], *before))
        before = [x + (r[k] or 0) for x, k in zip(before, sums, strict=True)]
    kind = ", ".join(["_part int", *(f"_{k} long" for k in sums)])
    known = df.sparkSession.createDataFrame(offsets, kind)
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = spread.join(F.broadcast(known), "_part")
    return out.withColumns({k: (F.sum(c).over(own) + F.col(f"_{k}")).cast("long") for k, c in sums.items()}).drop("_part", *(f"_{k}" for k in sums))


def unseen(df: DataFrame, done: DataFrame, key: str, position: str, start: int = 0, most: int | None = None, slice_first: bool = False) -> DataFrame:
    """Rows whose trimmed key is not in done, then rows from start on, at most `most`; or the slice before the skip."""
    def sliced(x: DataFrame) -> DataFrame:
        x = numbered(x, position).where(F.col("_n") >= start)
        return (x.where(F.col("_n") < start + most) if most is not None else x).drop("_n")

    seen = done.select(F.trim(key).alias("_k")).distinct()
    skip = lambda x: x.join(seen, F.trim(x[key]) == seen["_k"], "left_anti")
    return skip(sliced(df)) if slice_first else sliced(skip(df))


def batches(df: DataFrame, position: str, size: int) -> DataFrame:
    """batch: consecutive rows, `size` at a time, from 0."""
    return numbered(df, position).withColumn("batch", F.floor(F.col("_n") / size).cast("long")).drop("_n")


def concat_sources(named: dict[str, DataFrame]) -> DataFrame:
    """All rows, with a column `origin` that names the source; columns may differ."""
    out = None
    for name, df in named.items():
        df = df.withColumn("origin", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def load_sources(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, DataFrame]:
    """(rows, report): the rows of all sources that can be read whole, with a column `origin`, and a row (source, n, reason)
    for each source in order: how many rows it gave, or, with null for n, why it was skipped. A source is read once, into
    the shared folder, so one that breaks off in its middle gives nothing. rows is None if none can be read."""
    good, report = {}, []
    for name, read in readers.items():
        try:
            good[name] = settle(read(), "source")
            report.append((name, good[name].count(), None))
        except Exception as e:  # noqa: BLE001  whatever a source raises is its reason
            report.append((name, None, f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"))
    return (concat_sources(good) if good else None), spark.createDataFrame(report, "source string, n long, reason string")


def dead_letters(df: DataFrame, ok: str, reason: str, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows as (reason, payload as JSON))."""
    return df.where(F.col(ok)), df.where(~F.coalesce(F.col(ok), F.lit(False))).select(F.col(reason).alias("reason"), F.to_json(F.struct(*payload)).alias("payload"))


def write_dead_letters(failed: DataFrame, path: str) -> None:
    """Adds failed rows (reason, prompt, response and what else there is) to the dead letters at path, with the time."""
    failed.withColumn("failed_at", F.current_timestamp()).write.mode("append").json(path)


def ledger(outcomes: DataFrame, asked: int, target: int) -> DataFrame:
    """outcomes (batch, verdict: accepted, rejected, duplicate or similar) -> a row a batch with counts, missing (asked
    less what came), the running total of accepted rows and whether the target was reached before the batch."""
    kinds = ("accepted", "rejected", "duplicate", "similar")
    per = outcomes.groupBy("batch").agg(*[F.count_if(F.col("verdict") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("got"))
    per = per.withColumn("missing", F.greatest(F.lit(0).cast("long"), F.lit(asked) - F.col("got")))
    per = running(per, ["batch"], {"upto": "accepted"})
    per = per.withColumn("before", F.col("upto") - F.col("accepted")).drop("upto").where(F.col("before") < target)
    return per.withColumn("kept", F.least(F.col("accepted"), F.lit(target) - F.col("before"))).drop("before", "got")
