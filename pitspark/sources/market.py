"""Bars, corporate actions and delistings from CSV files, as observations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark import schema
from pitspark.functions.scalar import date_of_ns, iso_moment_ns, ns_of_date, session_close, ulid_column
from pitspark.sources import csv


def envelope(rows: DataFrame, *, adapter_id: str, source_id: str, suffix: Column | None = None, run_id: str = "unset", license_tag: str = "public", data_class: schema.DataClass = schema.DataClass.PUBLIC_AGGREGATE) -> DataFrame:
    """Observations of rows with signal_type, native_entity, both clocks, payload and maybe series_id and vintage_id. The id
    follows from source, signal, entity, day of the event and ``suffix``."""
    key = F.concat_ws("|", F.lit(source_id), "signal_type", "native_entity", date_of_ns(F.col("event_time_ns")).cast("string"), F.lit("") if suffix is None else suffix)
    made = {
        "observation_id": ulid_column(F.floor(F.col("event_time_ns") / 1_000_000).cast("long"), key), "schema_version": F.lit(schema.SCHEMA_VERSION), "run_id": F.lit(run_id), "source_id": F.lit(source_id), "adapter_id": F.lit(adapter_id),
        "security_id": F.lit(None), "ingest_time_ns": F.lit(0), "data_class": F.lit(int(data_class)), "license_tag": F.lit(license_tag), "derived_by": F.lit(None), "raw": F.lit(None),
    }
    for name in ("series_id", "vintage_id"):
        if name not in rows.columns:
            made[name] = F.lit("")
    return schema.conform(rows.withColumns(made))


@dataclass(frozen=True)
class MarketCsv:
    """Any of the three files may be missing. A file is read anew with every call."""

    spark: SparkSession
    bars_path: str | None = None
    corporate_actions_path: str | None = None
    delistings_path: str | None = None
    close: str = "21:00"
    adjustment_ref: str | None = None
    source_id: str = "market_csv"
    run_id: str = "unset"

    def _rows(self, frames: Sequence[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, frames)

    def bars(self, ids: Sequence[str] = (), window: tuple[int, int] | None = None) -> DataFrame:
        """A bar is known at its own stamp, which needs a zone, else at the day's close."""
        df = csv.read_csv(self.spark, self.bars_path, [csv.ENTITY, *"date open high low close volume".split()])
        day = csv.date_cell(df, "date")
        known = session_close(day, self.close)
        if "knowledge_time" in df.columns:
            known = F.when(F.col("knowledge_time") != "", iso_moment_ns(F.col("knowledge_time"))).otherwise(known)
        fields = F.struct(csv.text_cell(df, "adjustment_ref", self.adjustment_ref).alias("adjustment_ref"), *(csv.number_cell(df, c).alias(c) for c in ("close", "high", "low", "open", "volume")), csv.number_cell(df, "vwap", required=False).alias("vwap"))
        return self._select(df, "market.bar", day, known, fields, ids, window)

    def corporate_actions(self, ids: Sequence[str] = (), window: tuple[int, int] | None = None) -> DataFrame:
        """An action happens on its ex date and is known at the close of the day it was announced."""
        df = csv.read_csv(self.spark, self.corporate_actions_path, [csv.ENTITY, "action_type", "ex_date", "announced_on"])
        day, known = csv.date_cell(df, "ex_date"), session_close(csv.date_cell(df, "announced_on"), self.close)
        optional = lambda c: csv.date_cell(df, c, required=False).cast("string").alias(c)
        fields = F.struct(F.col("action_type"), csv.number_cell(df, "amount", required=False).alias("amount"), day.cast("string").alias("ex_date"), optional("pay_date"), csv.number_cell(df, "ratio", required=False).alias("ratio"), optional("record_date"))
        return self._select(df, "market.corporate_action", day, known, fields, ids, window, series=F.col("action_type"))

    def delistings(self, ids: Sequence[str] = (), window: tuple[int, int] | None = None) -> DataFrame:
        df = csv.read_csv(self.spark, self.delistings_path, [csv.ENTITY, "reason", "last_trade_date", "announced_on"])
        day, known = csv.date_cell(df, "last_trade_date"), session_close(csv.date_cell(df, "announced_on"), self.close)
        fields = F.struct(csv.text_cell(df, "final_value_policy", "last_price").alias("final_value_policy"), day.cast("string").alias("last_trade_date"), F.col("reason"))
        return self._select(df, "market.delisting", day, known, fields, ids, window)

    def _select(self, df: DataFrame, signal: str, day: Column, known: Column, fields: Column, ids: Sequence[str], window: tuple[int, int] | None, series: Column | None = None) -> DataFrame:
        rows = df.select(F.lit(signal).alias("signal_type"), csv.entity(df).alias("native_entity"), ns_of_date(day).alias("event_time_ns"), known.alias("knowledge_time_ns"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("payload"), (F.lit("") if series is None else series).alias("series_id"))
        out = envelope(rows, adapter_id="market_csv", source_id=self.source_id, suffix=F.col("series_id"), run_id=self.run_id)
        if ids:
            out = out.where(F.col("native_entity").isin(*ids))
        return in_window(out, window) if window else out

    def observations(self) -> DataFrame:
        made = [read() for path, read in ((self.bars_path, self.bars), (self.corporate_actions_path, self.corporate_actions), (self.delistings_path, self.delistings)) if path]
        if not made:
            raise csv.CsvError("no market file is given")
        return self._rows(made)

    def backfill(self, window: tuple[int, int]) -> DataFrame:
        return in_window(self.observations(), window)

    def capabilities(self) -> dict:
        """First day and entities of the source."""
        row = self.observations().agg(F.min("event_time_ns").alias("first"), F.sort_array(F.collect_set("native_entity")).alias("entities")).first()
        return {"coverage_start_ns": row["first"], "entities": row["entities"]}


def in_window(rows: DataFrame, window: tuple[int, int]) -> DataFrame:
    """Events from the start up to, not including, the end."""
    start, end = window
    if end <= start:
        raise ValueError("a window ends after it starts")
    return rows.where((F.col("event_time_ns") >= start) & (F.col("event_time_ns") < end))
