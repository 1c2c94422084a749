"""Bitemporal entity resolution and universe membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.functions.scalar import date_of_ns, fold_kind, normalize, ns_of_date


def in_force(day: Column) -> Column:
    """A mapping row counts on a day if it is known by then and the day lies in its validity, end excluded."""
    return (F.coalesce("known_from", "valid_from") <= day) & (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))


def resolve(rows: DataFrame, mapping: DataFrame, *, kind: str | Column = "ticker", day: Column | None = None, floor: float = 0.0, native: str = "native_entity") -> DataFrame:
    """``rows`` with ``security_id`` (best candidate of the day of knowledge; null below ``floor``), ``confidence`` and
    ``n_candidates`` (mapping rows in force). Best: highest confidence, then smallest security. A row that has a security keeps it and
    is not asked: its confidence is null and it has no candidates.

    What is asked depends on kind, normalised key and day alone, so each such question is answered once: the distinct
    questions meet the mapping in an equi join with the interval as residual, partial aggregates pick the best, and the rows
    take their answers by one equi join. Nothing is broadcast by force; AQE decides by size."""
    day = day if day is not None else date_of_ns(F.col("knowledge_time_ns"))
    kind = fold_kind(F.lit(kind) if isinstance(kind, str) else kind)
    asked = rows if "security_id" in rows.columns else rows.withColumn("security_id", F.lit(None).cast("string"))
    open_ = F.col("security_id").isNull()
    asked = asked.withColumns({"_kind": F.when(open_, kind), "_value": F.when(open_, normalize(kind, F.col(native))), "_day": F.when(open_, day)})
    known = mapping.select(fold_kind(F.col("kind")).alias("_kind"), normalize(F.col("kind"), F.col("value")).alias("_value"), F.col("security_id").alias("_sid"), "valid_from", "valid_to", "known_from", F.coalesce("confidence", F.lit(1.0)).alias("_conf"))
    keys = ["_kind", "_value", "_day"]
    hits = asked.where(open_).select(*keys).distinct().join(known, ["_kind", "_value"]).where(in_force(F.col("_day")))
    # min of (-confidence, security) is the best candidate
    best = hits.groupBy(*keys).agg(F.min(F.struct((-F.col("_conf")).alias("c"), F.col("_sid").alias("s"))).alias("_b"), F.count("*").alias("n_candidates"))
    out = asked.drop("confidence", "n_candidates").join(best, keys, "left").drop(*keys)
    confidence = -F.col("_b.c")
    return out.withColumns({"security_id": F.coalesce("security_id", F.when(confidence >= floor, F.col("_b.s"))), "confidence": confidence, "n_candidates": F.coalesce("n_candidates", F.lit(0).cast("long"))}).drop("_b")


def check_mapping(mapping: DataFrame) -> Column:
    """Why a mapping row is invalid; null: valid."""
    return F.coalesce(
        F.when(F.coalesce(F.trim("value"), F.lit("")) == "", F.lit("value is empty")),
        F.when(F.coalesce(F.trim("security_id"), F.lit("")) == "", F.lit("security_id is empty")),
        F.when(F.col("valid_to") <= F.col("valid_from"), F.lit("valid_to is not after valid_from")),
        F.when(~F.coalesce("confidence", F.lit(1.0)).between(0.0, 1.0), F.lit("confidence is not between 0 and 1")),
    )


def is_member(day: Column) -> Column:
    """Announced and added by the day, and not (removed and the removal announced) by then."""
    gone = (F.col("removed_on") <= day) & (F.col("removed_announced_on") <= day)
    return (F.col("announced_on") <= day) & (F.col("added_on") <= day) & ~F.coalesce(gone, F.lit(False))


def members_as_of(intervals: DataFrame, day: Column) -> DataFrame:
    """Distinct ``entity`` of a universe as it was known on a day, sorted."""
    return intervals.where(is_member(day)).select("entity").distinct().orderBy("entity")


def membership_edges(intervals: DataFrame, universe: str) -> DataFrame:
    """Two edges an interval: its addition, and its removal where that was announced. Each is known from the
    midnight of its own announcement, which is its vintage as well."""
    add = F.struct(F.lit("added").alias("edge"), F.col("added_on").alias("day"), F.col("announced_on").alias("announced"))
    gone = F.struct(F.lit("removed").alias("edge"), F.col("removed_on").alias("day"), F.col("removed_announced_on").alias("announced"))
    edges = intervals.select("entity", F.explode(F.array(add, gone)).alias("e")).where("e.day IS NOT NULL AND e.announced IS NOT NULL")
    return edges.select("entity", F.col("e.edge").alias("edge"), F.lit(universe).alias("series_id"), ns_of_date(F.col("e.day")).alias("event_time_ns"), ns_of_date(F.col("e.announced")).alias("knowledge_time_ns"), F.col("e.announced").cast("string").alias("vintage_id"), F.concat(F.lit(f"{universe}:"), F.col("e.edge")).alias("note"))
