"""Membership and entity mapping tables from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.operators import entities
from pitspark.sources import csv
from pitspark.sources.market import envelope


class SurvivorshipError(ValueError):
    """A list of today's members can't stand for a history."""


def memberships(spark: SparkSession, path: str) -> DataFrame:
    """entity, added_on, announced_on, removed_on, removed_announced_on. A list without dates is refused, as are removals
    that come before their addition or without an announcement."""
    try:
        df = csv.read_csv(spark, path, [csv.ENTITY, "added_on", "announced_on"])
    except csv.CsvError as e:
        raise SurvivorshipError(f"{e}. A membership file dates every addition and its announcement; a flat list of current members would leave out all that failed") from e
    out = df.select(csv.entity(df).alias("entity"), csv.date_cell(df, "added_on").alias("added_on"), csv.date_cell(df, "announced_on").alias("announced_on"), csv.date_cell(df, "removed_on", required=False).alias("removed_on"), csv.date_cell(df, "removed_announced_on", required=False).alias("removed_announced_on"))
    if bad := out.where("removed_on <= added_on").first():
        raise ValueError(f"{bad['entity']} is removed on {bad['removed_on']}, not after it is added")
    if bad := out.where("(removed_on IS NULL) <> (removed_announced_on IS NULL)").first():
        raise ValueError(f"{bad['entity']}: removed_on and removed_announced_on come together")
    return out


def membership_observations(intervals: DataFrame, *, universe: str, run_id: str = "unset") -> DataFrame:
    edges = entities.membership_edges(intervals, universe)
    fields = F.struct(F.lit(1).alias("entities_covered"), F.lit(False).alias("gap_marker"), F.col("note"), F.lit(True).alias("source_up"))
    rows = edges.select(F.lit("meta.coverage").alias("signal_type"), F.col("entity").alias("native_entity"), "series_id", "event_time_ns", "knowledge_time_ns", "vintage_id", "edge", F.to_json(fields).alias("payload"))
    return envelope(rows, adapter_id="universe_csv", source_id="universe_csv", suffix=F.concat_ws("|", "series_id", "edge", "vintage_id"), run_id=run_id)


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """kind, value, security_id, valid_from, valid_to, known_from, confidence."""
    df = csv.read_csv(spark, path, "kind value security_id valid_from".split())
    out = df.select("kind", "value", "security_id", csv.date_cell(df, "valid_from").alias("valid_from"), csv.date_cell(df, "valid_to", required=False).alias("valid_to"), csv.date_cell(df, "known_from", required=False).alias("known_from"), F.coalesce(csv.number_cell(df, "confidence", required=False), F.lit(1.0)).alias("confidence"))
    if bad := out.withColumn("why", entities.check_mapping(out)).where("why IS NOT NULL").first():
        raise ValueError(f"{path}: {bad['kind']} {bad['value']}: {bad['why']}")
    return out
