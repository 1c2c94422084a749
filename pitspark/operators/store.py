"""The observation store: immutable Parquet batches that a commit log makes visible, and snapshots of it."""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark import schema
from pitspark.functions.scalar import DAY_NS
from pitspark.operators import pit
from pitspark.operators.guard import ValidatedFrame
from pitspark.sources.files import Files

#: Two rows under one id are the same if these agree.
CONTENT = ("payload", "event_time_ns", "knowledge_time_ns")
#: A vintage is written once.
VINTAGE = ("native_entity", "signal_type", "series_id", "event_time_ns", "vintage_id")
ORDER = ("signal_type", "entity", "series_id", "event_time_ns", "knowledge_time_ns", "observation_id")


class StoreError(RuntimeError):
    """A write would change what is stored, or a snapshot isn't what it says."""


@dataclass(frozen=True)
class WriteReceipt:
    rows_written: int
    rows_skipped: int
    run_id: str


@dataclass(frozen=True)
class SnapshotRef:
    content_hash: str
    as_of_ns: int
    path: str


def repeated_ids(staged: DataFrame) -> DataFrame:
    """Ids that occur more than once in a batch, with the number of different contents."""
    return staged.groupBy("observation_id").agg(F.count("*").alias("n_rows"), F.countDistinct(*CONTENT).alias("n_contents")).where("n_rows > 1")


def stored_already(staged: DataFrame, stored: DataFrame) -> DataFrame:
    """Staged ids that are stored, and whether the content is the ``same``."""
    old = stored.select("observation_id", *(F.col(c).alias(f"_{c}") for c in CONTENT))
    same = F.lit(True)
    for c in CONTENT:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return staged.join(old, "observation_id").select("observation_id", same.alias("same"))


def unstored(staged: DataFrame, stored: DataFrame) -> DataFrame:
    return staged.join(stored.select("observation_id"), "observation_id", "left_anti")


def conflicts(staged: DataFrame, stored: DataFrame) -> DataFrame:
    """Staged rows whose vintage is stored under another id."""
    return staged.join(stored.select(*VINTAGE), list(VINTAGE), "left_semi")


def snapshot_rows(rows: DataFrame, *, as_of_ns: int) -> DataFrame:
    """All vintages that were knowable."""
    return rows.where(pit.knowable(as_of_ns))


def content_hash(rows: DataFrame, *, as_of_ns: int) -> DataFrame:
    """``row_count`` and ``content_hash``: sha256 over 256 sums of row hashes, which no order of rows or files changes.
    The sums aggregate partially, so nothing is sorted and only 256 rows are gathered."""
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    piece = lambda k: F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    by_bin = snapshot_rows(rows, as_of_ns=as_of_ns).groupBy(F.substring(row, 63, 2).alias("bin")).agg(F.count("*").alias("n"), *(F.sum(piece(k)).alias(f"s{k}") for k in range(4)))
    line = F.concat_ws(":", "bin", F.col("n").cast("string"), *(F.col(f"s{k}").cast("string") for k in range(4)))
    return by_bin.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("row_count"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("content_hash"))


#: Rows of a snapshot's file at most, so that each is small enough to be hashed at once.
FILE_ROWS = 1_000_000


def file_hashes(spark: SparkSession, folder: str) -> dict[str, str]:
    """sha256 of every Parquet file of a folder by its name; the files are read on the executors."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    return {r["name"]: r["sha"] for r in found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha")).collect()}


class SignalStore:
    """``path``, on any file system that Spark reads, holds ``data/batch=.../signal_type=.../*.parquet`` and ``_commits/<n>.json``. A
    batch counts only once its commit is there, which one rename does, so a failed write leaves nothing visible. One
    writer at a time: of two, the later commit fails."""

    def __init__(self, spark: SparkSession, path: str | os.PathLike[str]):
        self.spark, self.path, self.files = spark, str(path).rstrip("/"), Files(spark)
        self.files.mkdirs(f"{self.path}/_commits")

    def _commits(self) -> list[dict]:
        at = f"{self.path}/_commits"
        return [json.loads(self.files.read(f"{at}/{n}")) for n in self.files.names(at) if n.endswith(".json")]

    def _all(self) -> DataFrame:
        """One scan of all batches; filters on signal_type prune folders."""
        batches = [f"{self.path}/data/batch={c['batch']}" for c in self._commits()]
        if not batches:
            return self.spark.createDataFrame([], schema.OBSERVATION)
        stored = self.spark.read.schema(schema.OBSERVATION).option("basePath", f"{self.path}/data")
        return schema.conform(stored.parquet(*batches))

    def write(self, validated: ValidatedFrame, *, run_id: str) -> WriteReceipt:
        """Appends rows that aren't stored. In order: repeated ids in the batch, stored ids, vintages. The same content
        under a known id is skipped; another content, or a known vintage under a new id, is an error.

        Ids are looked up in the whole store, by id and content alone; vintages only among the signal types and events of the batch."""
        if not isinstance(validated, ValidatedFrame):
            raise TypeError("the store takes rows that the guard validated")
        batch = uuid.uuid4().hex
        at, staged_at = f"{self.path}/data/batch={batch}", f"{self.path}/_staging/{batch}"
        # staged once, so that every check and the write see the same rows
        schema.conform(validated.rows.withColumn("run_id", F.lit(run_id))).write.parquet(staged_at)
        try:
            staged = self.spark.read.schema(schema.OBSERVATION).parquet(staged_at)
            if bad := staged.where(schema.invalid_reason().isNotNull()).select("observation_id", schema.invalid_reason().alias("why")).first():
                raise schema.SchemaError(f"{bad['observation_id']}: {bad['why']}")
            if bad := repeated_ids(staged).where("n_contents > 1").first():
                raise StoreError(f"{bad['observation_id']} comes with two contents in one batch")
            once = staged.dropDuplicates(["observation_id"])
            if bad := once.groupBy(*VINTAGE).count().where("count > 1").first():
                raise StoreError(f"two rows of one batch are the vintage {bad['vintage_id']!r} of {bad['native_entity']}")
            stored = self._all()
            if bad := stored_already(once, stored).where("NOT same").first():
                raise StoreError(f"{bad['observation_id']} is stored with another content; restatements are new vintages")
            fresh = unstored(once, stored)
            span = staged.agg(F.count("*").alias("n"), F.min("event_time_ns").alias("lo"), F.max("event_time_ns").alias("hi"), F.collect_set("signal_type").alias("kinds")).first()
            near = stored.where(F.col("signal_type").isin(*span["kinds"]) & F.col("event_time_ns").between(span["lo"], span["hi"])) if span["n"] else stored
            if bad := conflicts(fresh, near).first():
                raise StoreError(f"the vintage {bad['vintage_id']!r} of {bad['native_entity']} is stored under another id")
            fresh.repartition("signal_type", F.floor(F.col("event_time_ns") / F.lit(32 * DAY_NS))).sortWithinPartitions("signal_type", "native_entity", "event_time_ns").write.partitionBy("signal_type").parquet(at)
            written = self.spark.read.schema(schema.OBSERVATION).parquet(at).count()
        finally:
            self.files.remove(staged_at)
        if written:
            self._publish({"batch": batch, "run_id": run_id, "rows": written})
        else:
            self.files.remove(at)
        return WriteReceipt(written, span["n"] - written, run_id)

    def _publish(self, commit: dict) -> None:
        n = len(self._commits())
        self.files.publish(f"{self.path}/_commits/{n:012d}.json", json.dumps(commit | {"at": time.time()}, sort_keys=True))

    def read(self, *, signal_type: str, as_of_ns: int, security_ids=None, event_start_ns=None, event_end_ns=None) -> DataFrame:
        """In the order of event, entity and series; an aggregate above drops the sort."""
        return pit.in_order(pit.pit_read(self._all(), as_of_ns=as_of_ns, signal_type=signal_type, security_ids=security_ids, event_start_ns=event_start_ns, event_end_ns=event_end_ns))

    def vintages(self, *, as_of_ns: int) -> DataFrame:
        """All vintages knowable at the cut."""
        return snapshot_rows(self._all(), as_of_ns=as_of_ns)

    def audit(self) -> DataFrame:
        """Every row, for inspection only."""
        return self._all()

    def snapshot(self, *, as_of_ns: int, target_dir: str | os.PathLike[str]) -> SnapshotRef:
        """All knowable vintages as sorted Parquet files, and a manifest. Rows and files are hashed on the executors."""
        target = str(target_dir).rstrip("/")
        rows = self.vintages(as_of_ns=as_of_ns)
        rows.withColumn("entity", F.coalesce("security_id", "native_entity")).orderBy(*ORDER).drop("entity").write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{target}/data")
        found = content_hash(self.spark.read.schema(schema.OBSERVATION).parquet(f"{target}/data"), as_of_ns=as_of_ns).first()
        manifest = {"content_hash": found["content_hash"], "as_of_ns": as_of_ns, "row_count": found["row_count"], "schema": schema.SCHEMA_VERSION, "files": file_hashes(self.spark, f"{target}/data")}
        self.files.publish(f"{target}/manifest.json", json.dumps(manifest, sort_keys=True, indent=1))
        return SnapshotRef(found["content_hash"], as_of_ns, target)

    def close(self) -> None:
        """Nothing stays open."""


class SnapshotStore:
    """A snapshot, read only. The files are verified against the manifest, and its hash against the pin if one is given."""

    def __init__(self, spark: SparkSession, path: str | os.PathLike[str], *, expected_content_hash: str | None = None):
        self.spark, self.path = spark, str(path).rstrip("/")
        files = Files(spark)
        if not files.exists(f"{self.path}/manifest.json"):
            raise StoreError(f"{path} holds no snapshot")
        self.manifest = json.loads(files.read(f"{self.path}/manifest.json"))
        self.content_hash, self.as_of_ns = self.manifest["content_hash"], self.manifest["as_of_ns"]
        if expected_content_hash is not None and expected_content_hash != self.content_hash:
            raise StoreError(f"the snapshot is {self.content_hash}, not {expected_content_hash}")
        try:
            found = file_hashes(spark, f"{self.path}/data")
        except (Py4JJavaError, PySparkException) as e:
            # the file system's own checksums may be the first to notice
            raise StoreError("the snapshot's files can't be read, so they are not those of its manifest") from e
        if found != self.manifest["files"]:
            raise StoreError("the snapshot's files are not those of its manifest")

    def as_snapshot_ref(self) -> SnapshotRef:
        return SnapshotRef(self.content_hash, self.as_of_ns, self.path)

    def vintages(self, *, as_of_ns: int) -> DataFrame:
        if as_of_ns > self.as_of_ns:
            raise StoreError("the snapshot doesn't reach so far")
        return snapshot_rows(self.spark.read.schema(schema.OBSERVATION).parquet(f"{self.path}/data"), as_of_ns=as_of_ns)

    def read(self, *, signal_type: str, as_of_ns: int, security_ids=None, event_start_ns=None, event_end_ns=None) -> DataFrame:
        return pit.in_order(pit.pit_read(self.vintages(as_of_ns=min(as_of_ns, self.as_of_ns)), as_of_ns=as_of_ns, signal_type=signal_type, security_ids=security_ids, event_start_ns=event_start_ns, event_end_ns=event_end_ns))

    def write(self, *_: object, **__: object) -> WriteReceipt:
        raise StoreError("a snapshot is read only")

    def snapshot(self, **_: object) -> SnapshotRef:
        raise StoreError("a snapshot is read only")
