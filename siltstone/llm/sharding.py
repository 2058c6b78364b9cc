"""Sharding by size-tiered compaction under a versioned manifest; DataFrame functions and file operations only.

Arrivals are appended as runs of immutable shards. A shard of half the target size or more is full and is never rewritten;
an arrival's full shards are a run of their own. Runs of small shards are merged, as soon as there are `fanout` of a like
size (one tier) or one of them reaches the target size, into files of half the target to the whole of it. Two small shards
always fit into one file, so every merge leaves fewer of them.
A run has an id of its own; its name is a label that may repeat. A version's manifest lists runs; each run's shards are
listed in a file of its own that never changes. A manifest is written aside and then takes its number in one step that
fails if another writer has taken it, so readers see one version or the other; the writer then tries again on the new
version. That step is atomic on the file systems in ATOMIC; others are refused unless only one writer is promised.
Earlier versions stay readable until vacuum() takes what no recent version lists.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: File systems on which a version is taken by one writer only: a hard link on local files, a rename on the others.
ATOMIC = ("file", "hdfs", "viewfs", "webhdfs", "ofs")
#: Shards whose places are broadcast at most (about 100 bytes each); beyond, they are joined.
BROADCAST_SHARDS = 50_000


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4, single_writer: bool = False):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path("").getFileSystem(self._conf)
        self.kinds: dict = {}
        self._scheme = self._fs.getUri().getScheme()
        if self._scheme not in ATOMIC and not single_writer:
            raise ValueError(f"no atomic commit on {self._scheme}:// is known; single_writer=True promises that no other writer is there")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _listed(self, name: str) -> list:
        path = self._path(name)
        return [s for s in self._fs.listStatus(path) if not s.getPath().getName().startswith(("_", "."))] if self._fs.exists(path) else []

    def _files(self, name: str) -> list[tuple[str, int]]:
        return sorted((s.getPath().getName(), s.getLen()) for s in self._listed(name) if not s.isDirectory())

    def _read_json(self, name: str):
        reader = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(self._fs.open(self._path(name)), "UTF-8"))
        try:
            return json.loads(reader.readLine())
        finally:
            reader.close()

    def _write_json(self, name: str, value):
        path = self._path(name)
        out = self._fs.create(path, False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        return path

    def version(self) -> int:
        return max([0, *(int(n[1:9]) for n, _ in self._files("manifests") if n.startswith("v"))])

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, runs: [{id, run, level, bytes, shards, folder, full}]}; of version 0, no runs."""
        version = self.version() if version is None else version
        return self._read_json(f"manifests/v{version:08d}.json") if version else {"version": 0, "schema": None, "runs": []}

    def files(self, run: dict) -> list[dict]:
        return self._read_json(f"runs/{run['id']}.json")

    def commit(self, manifest: dict, base: int) -> int:
        """Makes manifest version base + 1, or raises Conflict; never replaces a version."""
        self._fs.mkdirs(self._path("manifests"))
        aside = self._write_json(f"manifests/.{uuid.uuid4().hex}", manifest | {"version": base + 1})
        to = self._path(f"manifests/v{base + 1:08d}.json")
        try:
            if self._scheme == "file":
                local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(local(to), local(aside))
            else:
                rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
                options = self.spark.sparkContext._gateway.new_array(rename, 1)
                options[0] = rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(aside, to, options)
        except Exception as e:
            if self._fs.exists(to):
                raise Conflict(f"version {base + 1} is taken") from e
            raise
        finally:
            self._fs.delete(aside, False)
        return base + 1

    def tier(self, size: int) -> int:
        """Small runs of a tier are within a factor `fanout` of each other; -1: enough to be merged at once."""
        if size >= self.target:
            return -1
        return max(0, math.floor(math.log(max(1, size) / (self.target / self.fanout**3), self.fanout)) + 1)

    def full(self, size: int) -> bool:
        """A shard of this size is never rewritten."""
        return 2 * size >= self.target

    def _listed_run(self, name: str, folder: str, level: int, files: list[dict], full: bool) -> dict:
        run = {"id": uuid.uuid4().hex, "run": name, "level": level, "bytes": sum(f["bytes"] for f in files), "shards": len(files), "folder": folder, "full": full}
        self._fs.mkdirs(self._path("runs"))
        self._write_json(f"runs/{run['id']}.json", files)
        return run

    def _runs(self, name: str, folder: str, level: int) -> list[dict]:
        """Lists a written folder's shards as a run of full ones and a run of small ones; without shards, none. Nothing
        reads them before a commit."""
        files = [{"file": f"{folder}/{n}", "bytes": b} for n, b in self._files(folder)]
        kinds = [(kind, [f for f in files if self.full(f["bytes"]) == kind]) for kind in (True, False)]
        return [self._listed_run(name, folder, level, some, kind) for kind, some in kinds if some]

    def _added(self, runs: list[dict], schema: str) -> int:
        """Commits more runs on whatever version is the last."""
        while True:
            now = self.manifest()
            try:
                return self.commit(now | {"schema": schema, "runs": [*now["runs"], *runs]}, now["version"])
            except Conflict:
                continue

    def append(self, docs: DataFrame, by: str | None = None) -> int:
        """Appends docs as one arrival, or, written in one job, as an arrival for each value of column `by` in order;
        one commit for each. An arrival without rows is not committed. Returns the last version."""
        base = f"data/a-{uuid.uuid4().hex}"
        writer = docs.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{base}")
        schema = docs.drop(by).schema.json() if by else docs.schema.json()
        self.kinds = {f.name: f.dataType for f in docs.schema}
        parts = [s.getPath().getName() for s in self._listed(base) if s.isDirectory()] if by else [""]
        version = self.version()
        for part in sorted(parts, key=lambda p: (len(p), p)):
            runs = self._runs(part.partition("=")[2] or "arrival", f"{base}/{part}".rstrip("/"), 0)
            if runs:
                version = self._added(runs, schema)
        return version

    def _due(self, runs: list[dict], everything: bool) -> list[dict]:
        """The runs that are merged next. Versions written before runs were told apart by `full` list some without it:
        they count as small, and are rewritten where that leaves fewer shards."""
        tiers: dict[int, list[dict]] = {}
        for r in runs:
            if not r.get("full"):
                tiers.setdefault(self.tier(r["bytes"]), []).append(r)
        large = [r for r in tiers.pop(-1, []) if r["shards"] > 1]
        due = large or next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), [])
        if not due and everything:
            due = [r for t in sorted(tiers) for r in tiers[t]]
            due = due if sum(r["shards"] for r in due) > 1 else []
        return due

    def _swapped(self, gone: list[dict], runs: list[dict]) -> bool:
        """Commits runs in place of those that they merge, unless another writer has merged one of them."""
        ids = {r["id"] for r in gone}
        while True:
            now = self.manifest()
            if not ids <= {r["id"] for r in now["runs"]}:
                return False
            try:
                self.commit(now | {"runs": [r for r in now["runs"] if r["id"] not in ids] + runs}, now["version"])
                return True
            except Conflict:
                continue

    def _packed(self, schema: str, runs: list[dict]) -> DataFrame:
        """The runs' rows with a partition for each file to write: whole small files, largest first, up to the target size.
        Packing is that of Spark's file scan, in a session of its own with the target as its bound; where that bound does
        not hold, as many partitions as the target asks for."""
        own = self.spark.newSession()
        for key, value in {"maxPartitionBytes": self.target, "openCostInBytes": 0, "minPartitionNum": 1}.items():
            own.conf.set(f"spark.sql.files.{key}", str(value))
        rows = self._read(schema, runs, own)
        wanted = max(1, math.ceil(sum(r["bytes"] for r in runs) / self.target))
        return rows if rows.rdd.getNumPartitions() <= 2 * wanted else rows.coalesce(wanted)

    def compact(self, everything: bool = False) -> int:
        """Merges until no run of small shards reaches the target and no tier holds `fanout` runs; everything: until one
        small shard is left at most. Files of the runs that were merged stay, for readers of earlier versions, until
        vacuum(). Returns the version."""
        while True:
            now = self.manifest()
            due = self._due(now["runs"], everything)
            if not due:
                return now["version"]
            folder = f"data/m-{uuid.uuid4().hex}"
            self._packed(now["schema"], due).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            names = sorted({x for r in due for x in r["run"].split("+")}, key=lambda x: (len(x), x))
            runs = self._runs("+".join(names), folder, 1 + max(r["level"] for r in due))
            if not self._swapped(due, runs):
                self._fs.delete(self._path(folder), True)
                for r in runs:
                    self._fs.delete(self._path(f"runs/{r['id']}.json"), False)

    def vacuum(self, versions: int = 2, older_than_s: float = 7 * 86400.0) -> list[str]:
        """Removes folders and files that none of the last `versions` versions lists and whose last change is older than the
        given age, which must exceed the longest write before its commit and the longest read. Returns what it removed."""
        last, before = self.version(), (time.time() - older_than_s) * 1000
        known = [r for v in range(max(1, last - versions + 1), last + 1) for r in self.manifest(v)["runs"]]
        folders, ids = {r["folder"] for r in known}, {r["id"] for r in known}
        listed = {f["file"] for r in {r["id"]: r for r in known}.values() for f in self.files(r)}
        gone = []

        def newest(status) -> int:
            return max([status.getModificationTime(), *(newest(s) for s in self._fs.listStatus(status.getPath()))]) if status.isDirectory() else status.getModificationTime()

        for top in self._listed("data"):
            name = f"data/{top.getPath().getName()}"
            inner = [s for s in self._listed(name) if s.isDirectory()]
            for status, folder in [*((s, f"{name}/{s.getPath().getName()}") for s in inner), (top, name)]:
                if folder not in folders and not (folder == name and any(f.startswith(f"{name}/") for f in folders)) and newest(status) <= before:
                    self._fs.delete(self._path(folder), True)
                    gone.append(folder)
        for folder in folders:  # a folder's full shards stay when its small ones were merged
            for status in self._listed(folder):
                name = f"{folder}/{status.getPath().getName()}"
                if not status.isDirectory() and name not in listed and status.getModificationTime() <= before:
                    self._fs.delete(status.getPath(), False)
                    gone.append(name)
        for status in self._listed("runs"):
            if status.getPath().getName()[:-5] not in ids and status.getModificationTime() <= before:
                self._fs.delete(status.getPath(), False)
        return gone

    def _read(self, schema: str, runs: list[dict], spark: SparkSession | None = None) -> DataFrame:
        spark = spark or self.spark
        paths = [f"{self.root}/{f['file']}" for r in runs for f in self.files(r)]
        kind = StructType.fromJson(json.loads(schema))
        return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("nothing was appended")
        return self._read(m["schema"], m["runs"])

    def shards(self, version: int | None = None) -> DataFrame:
        """The manifest as rows: (version, run, level, shard, shard_bytes)."""
        m = self.manifest(version)
        rows = [(m["version"], r["run"], r["level"], f["file"], f["bytes"]) for r in m["runs"] for f in self.files(r)]
        return self.spark.createDataFrame(rows, "version long, run string, level int, shard string, shard_bytes long")


def arrival(doc_id):
    """Of 13 arrivals 12 bring a sixteenth of all documents each, the last a quarter; by crc32 of doc_id, null as ''."""
    return F.least(F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(16)), F.lit(12)).cast("int")


def shard(docs: DataFrame, root: str, target_bytes: int = 128 << 20, fanout: int = 4) -> ShardStore:
    """Appends docs, all their columns, as arrivals and compacts them; returns the store.

    Nulls, empty and very long texts, ties and repeated rows are stored as they are, extra columns whatever their names.
    Of an empty table the store has no version.
    """
    store = ShardStore(docs.sparkSession, root, target_bytes, fanout)
    by = "arrival_"
    while by in {c.lower() for c in docs.columns}:
        by += "_"
    key = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None)
    store.append(docs.withColumn(by, arrival(key)), by=by)
    store.compact(everything=True)
    return store


def placed(store: ShardStore, column: str = "doc_id") -> DataFrame:
    """(column, run, level, shard, shard_bytes, version) of each stored row, read back from the committed shards."""
    m = store.manifest()
    if not m["version"]:
        own = StructType.fromDDL("run string, level int, shard string, shard_bytes long, version long").fields
        return store.spark.createDataFrame([], StructType([StructField(column, store.kinds.get(column, LongType())), *own]))
    rows = store.read(m["version"]).select(F.col(f"`{column}`"), F.regexp_extract(F.col("_metadata.file_path"), r"(data/[am]-.*)$", 1).alias("shard"))
    at = store.shards(m["version"])
    at = F.broadcast(at) if sum(r["shards"] for r in m["runs"]) <= BROADCAST_SHARDS else at
    return rows.join(at, "shard").select(f"`{column}`", "run", "level", "shard", "shard_bytes", "version")


def audit(store: ShardStore, target_bytes: int = 128 << 20) -> DataFrame:
    """(doc_id, copies, chars, compacted): the stored rows and their texts' characters by doc_id, read back, and whether
    one committed shard at most is under half the target size."""
    m = store.manifest()
    if not m["version"]:
        return store.spark.createDataFrame([], "doc_id long, copies long, chars long, compacted boolean")
    small = store.shards(m["version"]).where(F.col("shard_bytes") * 2 < target_bytes).count()
    rows = store.read(m["version"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"))
    return rows.withColumn("compacted", F.lit(small <= 1))
