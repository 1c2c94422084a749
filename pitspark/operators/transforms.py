"""Cross-sectional transforms on long tables (date, entity, value), for all dates in one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATE, ENTITY, VALUE = "rebalance_date", "entity", "value"
Op = Callable[..., DataFrame]
_OPS: dict[str, Op] = {}


class TransformError(ValueError):
    """A transform is unknown, taken, or not defined for a cross-section."""


def register_op(name: str) -> Callable[[Op], Op]:
    """Adds ``op(section, **params) -> section`` to the ops that a factor may name."""

    def add(op: Op) -> Op:
        if name in _OPS:
            raise TransformError(f"op {name!r} is registered already")
        _OPS[name] = op
        return op

    return add


def get_op(name: str) -> Op:
    if name not in _OPS:
        raise TransformError(f"unknown op {name!r}; known: {', '.join(registered_ops())}")
    return _OPS[name]


def registered_ops() -> list[str]:
    return sorted(_OPS)


def _over(*keys: str) -> Any:
    return Window.partitionBy(DATE, *keys)


def _must(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


@register_op("pct_change")
def pct_change(section: DataFrame, *, base: DataFrame | None = None, zero_base: str = "fail", **_: Any) -> DataFrame:
    """(x - base) / |base|; entities without a base go. A base of 0 fails the build or, with ``zero_base="ieee"``, divides as
    doubles do: an infinity of x's sign, NaN if x is 0. ``base`` is a section, or a column of this one (see ``with_base``), which goes."""
    if zero_base not in ("fail", "ieee"):
        raise TransformError("pct_change: zero_base is fail or ieee")
    joined = section.withColumnRenamed("base", "_base") if base is None else section.join(base.select(DATE, ENTITY, F.col(VALUE).alias("_base")), [DATE, ENTITY])
    joined = joined.where("_base IS NOT NULL")
    change = (F.col(VALUE) - F.col("_base")) / F.abs("_base")
    if zero_base == "ieee":
        # a plain division by 0 is an error in ANSI mode
        change = F.when(F.col("_base") != 0, change).otherwise(F.col(VALUE) * F.lit(float("inf")))
    else:
        change = _must(F.col("_base") != 0, change, "pct_change: a base is 0")
    return joined.withColumn(VALUE, change).drop("_base")


def with_base(values: DataFrame) -> DataFrame:
    """A section with the column ``base``, of values (date, entity, value) that ``back`` (false, true) marks as those of the
    date or of its base: both come from one read."""
    both = values.groupBy(DATE, ENTITY).agg(*(F.max(F.when(F.col("back") == back, F.col(VALUE))).alias(name) for name, back in ((VALUE, False), ("base", True))))
    return both.where(F.col(VALUE).isNotNull())


@register_op("winsorize")
def winsorize(section: DataFrame, *, limits: tuple[float, float] = (0.01, 0.99), **_: Any) -> DataFrame:
    """Values clamped to the section's linearly interpolated quantiles."""
    low, high = limits
    if not 0 <= low <= high <= 1:
        raise TransformError("winsorize: limits are 0 <= low <= high <= 1")
    bounds = F.percentile(VALUE, F.array(F.lit(low), F.lit(high))).over(_over())
    return section.withColumn("_b", bounds).withColumn(VALUE, F.least(F.greatest(VALUE, F.col("_b")[0]), F.col("_b")[1])).drop("_b")


@register_op("sector_neutralize")
def sector_neutralize(section: DataFrame, *, sectors: DataFrame | Mapping[str, str], **_: Any) -> DataFrame:
    """Values less their sector's mean; entities without a sector go. ``sectors``: entity, label, and the date if labels change."""
    if not isinstance(sectors, DataFrame):
        sectors = section.sparkSession.createDataFrame(list(sectors.items()), f"{ENTITY} string, label string")
    on = [c for c in (DATE, ENTITY) if c in sectors.columns]
    labelled = section.join(sectors.select(*on, "label").where("label IS NOT NULL"), on)
    return labelled.withColumn(VALUE, F.col(VALUE) - F.avg(VALUE).over(_over("label"))).drop("label")


@register_op("cross_sectional_rank")
def cross_sectional_rank(section: DataFrame, **_: Any) -> DataFrame:
    """Average rank of ties, from 0 to 1; a section of one has 0.5."""
    n, ties = F.count("*").over(_over()), F.count("*").over(_over(VALUE))
    rank = F.rank().over(_over().orderBy(VALUE)) - 1 + (ties - 1) / 2
    return section.withColumn(VALUE, F.when(n == 1, F.lit(0.5)).otherwise(rank / F.nullif(n - 1, F.lit(0))))


@register_op("zscore")
def zscore(section: DataFrame, **_: Any) -> DataFrame:
    """(x - mean) / sample deviation, never a negative zero; equal values give 0, a section of one fails the build."""
    n, mean, sd = F.count("*").over(_over()), F.avg(VALUE).over(_over()), F.stddev_samp(VALUE).over(_over())
    flat = F.max(VALUE).over(_over()) == F.min(VALUE).over(_over())
    z = F.when(F.col("_flat"), F.lit(0.0)).otherwise((F.col(VALUE) - F.col("_mean")) / F.col("_sd") + F.lit(0.0))
    with_stats = section.withColumns({"_n": n, "_mean": mean, "_sd": sd, "_flat": flat})
    return with_stats.withColumn(VALUE, _must(F.col("_n") > 1, z, "zscore: a section has one member")).drop("_n", "_mean", "_sd", "_flat")


def diagnostics(section: DataFrame, dates: DataFrame) -> DataFrame:
    """Coverage, mean, population deviation, least and greatest value of every date; dates without members have 0 and nulls."""
    stats = section.groupBy(DATE).agg(F.count(VALUE).alias("coverage"), F.avg(VALUE).alias("mean"), F.stddev_pop(VALUE).alias("stddev"), F.min(VALUE).alias("low"), F.max(VALUE).alias("high"))
    return dates.select(DATE).join(stats, DATE, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0).cast("long")))
