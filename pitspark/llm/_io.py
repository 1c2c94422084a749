"""Shared scratch space, the only place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset (a test on one machine) a new
    temporary folder, which then is the session's checkpoint folder too."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='pitspark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


def grows(df: DataFrame) -> DataFrame:
    """For a side of a join that grows with the corpus: it is never broadcast, so the plan is the same at every size."""
    return df.hint("merge")


_WRITTEN: list[str] = []


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    at = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(at)
    written = df.sparkSession.read.schema(df.schema).parquet(at)
    written.scratch_path = at
    _WRITTEN.append(at)
    return written


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: a table in the shared folder, which survives the loss of executors."""
    return table(df, "cut")


def remove(written: DataFrame) -> None:
    """Deletes what ``table`` wrote. Everything that comes from it must have been cut before."""
    delete(written.sparkSession, written.scratch_path)
    _WRITTEN.remove(written.scratch_path)


def mark() -> int:
    """For ``sweep``: what is written from now on."""
    return len(_WRITTEN)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Deletes what ``table`` and ``cut`` wrote in this process since a ``mark``. Results that rest on it must be written elsewhere before."""
    while len(_WRITTEN) > since:
        delete(spark, _WRITTEN.pop())


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
