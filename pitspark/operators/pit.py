"""Point-in-time reads. No read exists without an as-of cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions.scalar import DAY_NS, entity_key

#: Newest first; the last word among rows of one knowledge time.
_NEWEST = ("knowledge_time_ns", "vintage_id", "observation_id")


def knowable(as_of_ns: int | Column) -> Column:
    return F.col("knowledge_time_ns") <= (F.lit(as_of_ns) if isinstance(as_of_ns, int) else as_of_ns)


def pit_read(rows: DataFrame, *, as_of_ns: int, signal_type: str | None = None, security_ids: Sequence[str] | None = None, event_start_ns: int | None = None, event_end_ns: int | None = None, series_id: str | None = None) -> DataFrame:
    """Of each entity, series and event time the newest vintage that was knowable at ``as_of_ns``.

    All filters lie below the window, where they reach the scan; that of knowledge time would be wrong above.
    ``security_ids`` never matches rows without a security, although the key falls back on the native entity."""
    hit = rows.where(knowable(as_of_ns))
    if signal_type is not None:
        hit = hit.where(F.col("signal_type") == signal_type)
    if security_ids is not None:
        hit = hit.where(F.col("security_id").isin(*security_ids))
    if event_start_ns is not None:
        hit = hit.where(F.col("event_time_ns") >= event_start_ns)
    if event_end_ns is not None:
        hit = hit.where(F.col("event_time_ns") < event_end_ns)
    if series_id is not None:
        hit = hit.where(F.col("series_id") == series_id)
    return newest_vintage(hit)


def newest_vintage(rows: DataFrame, *also: str) -> DataFrame:
    """One row per signal type, entity, series and event time (and ``also``)."""
    key = F.coalesce("security_id", "native_entity")
    w = Window.partitionBy("signal_type", key, "series_id", "event_time_ns", *also).orderBy(*(F.desc(c) for c in _NEWEST))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


#: Cuts up to this many rows are broadcast, more of them are shuffled.
MAX_BROADCAST_CUTS = 10_000
#: Cuts and vintages meet in buckets of the knowledge axis, of 30 days or, over a long span of cuts, as many as make MAX_BUCKETS.
CUT_BUCKET_NS, MAX_BUCKETS = 30 * DAY_NS, 512


def pit_read_dates(rows: DataFrame, cuts: DataFrame, *, as_of: str = "as_of_ns", max_broadcast: int = MAX_BROADCAST_CUTS) -> DataFrame:
    """``pit_read`` at many cuts at once. Each vintage holds on the knowledge axis from its own time until the next
    vintage of its key; ``cuts`` (one row per date) meet the vintage that holds at their time. Each row joins only
    the cuts of its interval, so the result has one row per key and cut, and vintages that no cut sees vanish.

    What becomes known after the last cut cannot matter and is left out at the scan. Vintages and cuts meet in an equi
    join on buckets, an interval being listed in every bucket that it shares with the span of the cuts."""
    n, first, last = cuts.agg(F.count("*"), F.min(as_of), F.max(as_of)).first()
    if not n:
        first = last = 0
    width = max(CUT_BUCKET_NS, -(-(last - first) // MAX_BUCKETS))
    key = F.coalesce("security_id", "native_entity")
    w = Window.partitionBy("signal_type", key, "series_id", "event_time_ns").orderBy(*_NEWEST)
    held = rows.where(knowable(last)).withColumn("_until", F.lead("knowledge_time_ns").over(w))
    # vintages of one knowledge time: only the last in order ever holds; what ends before the first cut is never seen
    held = held.where((F.col("_until").isNull() | (F.col("_until") > F.col("knowledge_time_ns"))) & (F.col("_until").isNull() | (F.col("_until") > first)))
    bucket = lambda ns: ((ns - F.lit(first)) / F.lit(width)).cast("int")
    spans = F.sequence(bucket(F.greatest("knowledge_time_ns", F.lit(first))), bucket(F.coalesce("_until", F.lit(last))))
    marked = cuts.withColumn("_bucket", bucket(F.col(as_of)))
    holds = (F.col("knowledge_time_ns") <= F.col(as_of)) & (F.col("_until").isNull() | (F.col(as_of) < F.col("_until")))
    joined = held.withColumn("_bucket", F.explode(spans)).join(F.broadcast(marked) if n <= max_broadcast else marked, "_bucket")
    return joined.where(holds).drop("_until", "_bucket")


def in_order(rows: DataFrame) -> DataFrame:
    """The order of a read: event, entity, series."""
    return rows.orderBy("event_time_ns", F.coalesce("security_id", "native_entity"), "series_id")


def latest_in_force(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """Of each entity (and ``by``) the value of the newest event that has one. Rows are those of a point-in-time read."""
    valued = rows.withColumn("_v", value).where("_v IS NOT NULL").withColumn("entity", entity_key())
    return valued.groupBy(*by, "entity").agg(F.max_by("_v", "event_time_ns").alias("value"), F.max("event_time_ns").alias("event_time_ns"))


def covered(rows: DataFrame, least: int, sample: Column) -> DataFrame:
    """Rows with a sample of ``least`` or more. Apply it after the vintage is picked: a thin newest vintage hides
    its event, it doesn't bring an older vintage back."""
    return rows.where(sample >= least)


def several_series(rows: DataFrame, *by: str) -> DataFrame:
    """Entities that a read gives more than one series."""
    return rows.withColumn("entity", entity_key()).groupBy(*by, "entity").agg(F.countDistinct("series_id").alias("n_series")).where("n_series > 1")


def embargoed_cuts(dates: DataFrame, embargo_days: int, *, day: str = "rebalance_date") -> DataFrame:
    """``as_of_ns``: midnight of the date less the embargo, in calendar days."""
    return dates.withColumn("as_of_ns", (F.unix_date(day).cast("long") - embargo_days) * F.lit(DAY_NS))


def publication_lag(rows: DataFrame) -> DataFrame:
    return rows.withColumn("lag_ns", F.col("knowledge_time_ns") - F.col("event_time_ns"))
