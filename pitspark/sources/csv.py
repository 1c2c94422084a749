"""CSV tables as text columns, and strict conversions of their cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = ("security", "ticker", "symbol")
_BOM = "﻿"


class CsvError(ValueError):
    """A file lacks a column."""


def read_csv(spark: SparkSession, path: str, required: Sequence[str | Sequence[str]]) -> DataFrame:
    """All cells as trimmed texts, null where a column is short; column names in lower case. An entry of ``required`` is a
    name, or several of which one must be there. Rows that are blank in all required columns are left out."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).csv(path)
    names = [c.strip().strip(_BOM).strip().lower() for c in raw.columns]
    groups = [(g,) if isinstance(g, str) else tuple(g) for g in required]
    if missing := [" or ".join(g) for g in groups if not set(g) & set(names)]:
        raise CsvError(f"{path} has no column {', '.join(missing)}; it has {', '.join(names)}")
    df = raw.toDF(*names).select(*(F.trim(F.coalesce(F.col(f"`{n}`"), F.lit(""))).alias(n) for n in names))
    present = [n for g in groups for n in g if n in names]
    return df.where(F.concat(*present) != "") if present else df


def _raise(df: DataFrame, message: Column) -> Column:
    """Raises, but not for a blank row: the optimizer may compute a column before the filter that drops it."""
    return F.when(F.concat(*(F.col(f"`{c}`") for c in df.columns)) != "", F.raise_error(message))


def entity(df: DataFrame) -> Column:
    """The first entity column that holds something; none raises."""
    found = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ENTITY if c in df.columns))
    return F.coalesce(found, _raise(df, F.lit("a row names no security, ticker or symbol")))


def _cell(df: DataFrame, name: str) -> Column:
    return F.nullif(F.col(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def _parsed(df: DataFrame, name: str, value: Column, kind: str, required: bool) -> Column:
    cell = _cell(df, name)
    wrong = _raise(df, F.concat(F.lit(f"{name} is not a {kind}: "), F.coalesce(cell, F.lit("nothing")))).cast(kind)
    return F.when(cell.isNull() & F.lit(not required), F.lit(None).cast(kind)).otherwise(F.coalesce(value, wrong))


def date_cell(df: DataFrame, name: str, *, required: bool = True) -> Column:
    cell = _cell(df, name)
    return _parsed(df, name, F.when(cell.rlike(r"^\d{4}-\d{2}-\d{2}$"), cell.try_cast("date")), "date", required)


def number_cell(df: DataFrame, name: str, *, required: bool = True) -> Column:
    return _parsed(df, name, _cell(df, name).try_cast("double"), "double", required)


def text_cell(df: DataFrame, name: str, default: str | None = None) -> Column:
    return F.coalesce(_cell(df, name), F.lit(default).cast("string"))
