"""Summaries of an observation table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("run_id").alias("n_runs"), F.max("ingest_time_ns").alias("last_ingest_ns"))


def by_signal(rows: DataFrame) -> DataFrame:
    """Rows, entities, resolved rows and their share, vintages, and the ends of both clocks of each signal type."""
    stats = rows.groupBy("signal_type").agg(
        F.count("*").alias("n_rows"), F.countDistinct(F.coalesce("security_id", "native_entity")).alias("n_entities"), F.count("security_id").alias("n_resolved"), F.countDistinct("vintage_id").alias("n_vintages"),
        F.min("event_time_ns").alias("first_event_ns"), F.max("event_time_ns").alias("last_event_ns"), F.max("knowledge_time_ns").alias("last_knowledge_ns"),
    )
    return stats.withColumn("coverage", F.col("n_resolved") / F.greatest("n_rows", F.lit(1))).orderBy("signal_type")


def coverage(rows: DataFrame) -> DataFrame:
    """Of each signal type of a source its first event and its number of entities."""
    return rows.groupBy("signal_type").agg(F.min("event_time_ns").alias("first_event_ns"), F.countDistinct("native_entity").alias("n_entities"))


def lines(rows: DataFrame) -> list[str]:
    """A readable report; the table of signal types is small."""
    t = totals(rows).first()
    out = [f"{t['n_rows']} rows from {t['n_runs']} runs"]
    for r in by_signal(rows).collect():
        out.append(f"{r['signal_type']}: {r['n_rows']} rows, {r['n_entities']} entities, {r['coverage']:.1%} resolved, {r['n_vintages']} vintages")
    return out
