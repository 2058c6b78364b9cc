"""Rows through a model that the caller gives: built once a worker, called on batches, tried again, failures kept apart."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from siltstone.sources.tables import drop_settled, settle, write_dead_letters

#: What a call gets: rows as dicts; what it gives: for each a dict of results, or an exception for a row that it refuses.
Call = Callable[[list[dict]], list]
#: A worker's models, kept from task to task.
_MODELS: dict[str, Call] = {}


def attempt(call: Call, rows: list[dict], tries: int, wait_s: float) -> list[tuple[object, int]]:
    """(result or exception, tries that it took) of each row. A batch that fails is tried again after wait_s, 2 wait_s, ...
    seconds; one that fails each time is halved, so that a row that always fails fails alone."""
    failed: Exception = RuntimeError("never tried")
    for n in range(1, tries + 1):
        try:
            out = list(call(rows))
            if len(out) != len(rows):
                raise ValueError(f"{len(out)} results for {len(rows)} rows")
            return [(x, n) for x in out]
        except Exception as e:  # noqa: BLE001  what a model raises is its own affair, and is kept as the row's reason
            failed = e
            if n < tries and wait_s:
                time.sleep(wait_s * 2 ** (n - 1))
    if len(rows) == 1:
        return [(failed, tries)]
    half = len(rows) // 2
    return attempt(call, rows[:half], tries, wait_s) + attempt(call, rows[half:], tries, wait_s)


def _groups(batches: Iterator[pa.RecordBatch], rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of up to `rows` rows and about `most` bytes; a larger row is a slice of its own."""
    for batch in batches:
        each = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(rows, most // each))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def score(df: DataFrame, keys: list[str], load: Callable[[], Call], results: str, rows: int = 64, most_bytes: int = 8 << 20, tries: int = 3, wait_s: float = 0.0) -> DataFrame:
    """df -> (*keys, the result columns, reason, tries), a row for each row.

    load builds the model, once in a worker; what it returns is called with lists of df's rows as dicts, at most `rows` of
    them and most_bytes, and gives a dict by the columns of `results` (DDL) or an exception for each. reason is null, or
    says why a row has no results: what the model raised or refused, or that a result does not fit its column. Null keys and
    repeated rows are scored like others; an empty table gives no rows. keys may not name a result column.
    """
    own = StructType.fromDDL(results)
    schema = StructType([*(StructField(k, df.schema[k].dataType) for k in keys), *own.fields, *StructType.fromDDL("reason string, tries int").fields])
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in own.fields]
    name = uuid.uuid4().hex

    def checked(x: object) -> tuple[dict, str | None]:
        if isinstance(x, Exception):
            return {}, f"{type(x).__name__}: {x}"
        try:
            for column, kind in kinds:
                pa.array([x.get(column)], kind)
            return x, None
        except Exception as e:  # noqa: BLE001  any misfit is the row's reason
            return {}, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = load()
        for part in _groups(batches, rows, most_bytes):
            done = attempt(_MODELS[name], part.to_pylist(), tries, wait_s)
            good = [checked(x) for x, _ in done]
            values = [pa.array([x.get(c) for x, _ in good], kind) for c, kind in kinds]
            yield pa.record_batch([*(part.column(part.schema.get_field_index(k)) for k in keys), *values, pa.array([r for _, r in good], pa.string()), pa.array([n for _, n in done], pa.int32())], schema.names)

    return df.mapInArrow(run, schema)


def read_scored(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """What score_missing has written at sink; nothing where that is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(sink)


def score_missing(df: DataFrame, key: str, load: Callable[[], Call], results: str, sink: str, dead: str, payload: list[str], run: int, **how) -> dict[str, int]:
    """Scores the rows of df whose key is not at sink and adds them there, with `run`; rows without results go to the dead
    letters at `dead`, with reason and payload, and are scored again by the next run. Returns how many were asked, scored
    and failed. Of rows with one key one is scored; rows without a key are left out. Results are written before they are
    shared out, so no row is scored twice in a run; a run that is lost before it adds its rows leaves them missing.
    """
    spark = df.sparkSession
    schema = StructType([StructField(key, df.schema[key].dataType), *StructType.fromDDL(results).fields, StructField("run", StructType.fromDDL("run int").fields[0].dataType)])
    done = read_scored(spark, sink, schema).select(key)
    missing = df.where(F.col(key).isNotNull()).dropDuplicates([key]).join(done, key, "left_anti")
    scored = settle(score(missing, [key], load, results, **how), "scored")
    counts = scored.agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("reason").isNull()).alias("scored")).first()
    if counts.scored:
        scored.where("reason is null").drop("reason", "tries").withColumn("run", F.lit(run)).write.mode("append").parquet(sink)
    if counts.asked > counts.scored:
        failed = scored.where("reason is not null").select(key, "reason", "tries")
        rows = df.dropDuplicates([key]).select(key, F.to_json(F.struct(*payload)).alias("payload"))
        write_dead_letters(failed.join(rows, key).withColumn("run", F.lit(run)), dead)
    drop_settled(scored)
    return {"asked": counts.asked, "scored": counts.scored, "failed": counts.asked - counts.scored}
