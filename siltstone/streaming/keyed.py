"""Resuming by state (an extension): what was taken is remembered by key in Spark's state store, not read from the sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Once(StatefulProcessor):
    """Of a key's rows the first by `order`, if the key is not remembered."""

    def __init__(self, order: str, forget_s: int | None):
        self.order, self.forget_s = order, forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "taken boolean", self.forget_s * 1000 if self.forget_s else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        firsts = [x.sort_values(self.order, kind="stable").iloc[:1] for x in rows if len(x)]
        if firsts:
            self.seen.update((True,))
            yield pd.concat(firsts).sort_values(self.order, kind="stable").iloc[:1].drop(columns="_key", errors="ignore")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))


def read_taken(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """All rows at sink, whichever run and micro-batch wrote them; none where it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(sink)


def resume_keyed(
    spark: SparkSession, source: str, sink: str, checkpoint: str, schema: StructType, key: str, order: str,
    work: Callable[[DataFrame], DataFrame] = lambda df: df, forget_s: int | None = None, files: int = 1000,
) -> StreamingQuery:
    """Takes Parquet files that arrive in source and adds what `work` makes of the first row of each trimmed key to sink.

    A key is taken once, however often and however late it comes again: keys are state, which a restart with the same
    checkpoint finds again. With a new checkpoint the keys at sink (which work must keep) are the state to begin with;
    after that the sink is not read, so a micro-batch costs what its rows cost. forget_s: a key is forgotten so many
    seconds of processing time after it was taken. Of a key's rows in one micro-batch (at most `files` files) the one with
    the least `order` is taken; null keys are left out. Each micro-batch has a folder of its own at sink and replaces it if
    it is run again, so nothing is added twice; read_taken reads them all. The session's settings stay as they are.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    out = StructType([f for f in schema.fields])
    taken = read_taken(own, sink, schema).select(F.trim(F.col(key).cast("string")).alias("_key")).where("_key is not null").distinct()
    rows = own.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    rows = rows.withColumn("_key", F.trim(F.col(key).cast("string"))).where("_key is not null")
    mode = "ProcessingTime" if forget_s else "None"
    first = rows.groupBy("_key").transformWithStateInPandas(_Once(order, forget_s), out, "Append", mode, initialState=taken.groupBy("_key"))
    run = checkpoint.rstrip("/").rpartition("/")[2]

    def add(df: DataFrame, batch: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{sink}/{run}-{batch:09d}")

    return first.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
