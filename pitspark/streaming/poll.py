"""Incremental polls by knowledge time.

A source is read again at each poll, because rows may be appended to files that are known. A poll emits what
became knowable since the last one; the next floor is the latest stamp emitted, not the wall clock, so rows
stamped in the future come with a later poll. A row that arrives late with a stamp under the floor is not
polled; a backfill finds it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.sources.files import Files


def increment(rows: DataFrame, *, floor_ns: int | None, now_ns: int) -> DataFrame:
    hit = rows.where(F.col("knowledge_time_ns") <= now_ns)
    return hit if floor_ns is None else hit.where(F.col("knowledge_time_ns") > floor_ns)


class Poller:
    """Micro-batches of a source into ``sink``. The floor is kept in the file ``checkpoint``, on any file system, and moves after the sink has
    taken the batch, so a batch may come twice but is never lost; the store skips rows that it has."""

    def __init__(self, source: Callable[[], DataFrame], sink: Callable[[DataFrame], object], checkpoint: str | os.PathLike[str]):
        self.source, self.sink, self.path = source, sink, str(checkpoint)

    @property
    def floor_ns(self) -> int | None:
        files = Files(SparkSession.active())
        return json.loads(files.read(self.path))["floor_ns"] if files.exists(self.path) else None

    def poll(self, *, now_ns: int) -> object | None:
        """What the sink returns; None: nothing new."""
        batch = increment(self.source(), floor_ns=self.floor_ns, now_ns=now_ns)
        last = batch.agg(F.max("knowledge_time_ns")).first()[0]
        if last is None:
            return None
        # the bound makes the batch the one that was measured, even if the source has grown meanwhile
        result = self.sink(batch.where(F.col("knowledge_time_ns") <= last))
        Files(SparkSession.active()).publish(self.path, json.dumps({"floor_ns": last}), replace=True)
        return result


def stream_files(spark, path: str, schema, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Structured Streaming over a folder in which files only ever appear whole: each micro-batch goes to ``write``."""
    source = spark.readStream.schema(schema).parquet(path)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
