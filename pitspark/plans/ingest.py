"""Ingest: read sources, resolve entities at the day of knowledge, guard, append."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.operators import entities
from pitspark.operators.guard import Guard, Manifest
from pitspark.operators.store import SignalStore, WriteReceipt
from pitspark.plans.adapters import get_adapter
from pitspark.sources import reference
from pitspark.sources.ratelimit import RateLimiter
from pitspark.sources.settings import AdapterSettings, Settings
from pitspark.streaming.poll import Poller


class IngestError(ValueError):
    """A run can't start as it is set up."""


@dataclass
class AdapterReport:
    adapter_id: str
    written: int = 0
    skipped: int = 0
    resolved: int = 0
    unresolved: int = 0
    rejected: dict[str, int] = field(default_factory=dict)
    throttled_seconds: float = 0.0


def limiter_of(settings: Settings, a: AdapterSettings, shared: dict[str, RateLimiter]) -> RateLimiter | None:
    """The limiter of the adapter's provider, one for all its adapters; None: no limit is set."""
    limit = settings.rate_limits.get(a.limited_by)
    if limit is None:
        return None
    if a.limited_by not in shared:
        shared[a.limited_by] = RateLimiter(limit.requests_per_second, limit.burst)
    return shared[a.limited_by]


def ingest_rows(rows: DataFrame, *, store: SignalStore, guard: Guard, manifest: Manifest, mode: str, run_id: str, now_ns: int, mapping: DataFrame | None = None, kind: str = "ticker", floor: float = 0.0) -> AdapterReport:
    """One batch through resolution, stamp, guard and store. Resolution counts include rows that the guard rejects."""
    asked = F.col("security_id").isNull()
    resolved = unresolved = F.lit(0)
    if mapping is not None:
        # only rows that come without a security are asked and counted
        rows = rows.withColumn("_asked", asked)
        resolved, unresolved = F.count_if(F.col("_asked") & ~asked), F.count_if(F.col("_asked") & asked)
        rows = entities.resolve(rows, mapping, kind=kind, floor=floor).drop("confidence", "n_candidates")
    rows = rows.withColumn("ingest_time_ns", F.lit(now_ns))
    report = AdapterReport(manifest.adapter_id)
    accepted, rejected = guard.split(rows, manifest=manifest, mode=mode, now_ns=now_ns)
    report.resolved, report.unresolved = rows.agg(resolved.cast("long"), unresolved.cast("long")).first()
    report.rejected = {r["reject_rule"]: r["count"] for r in rejected.groupBy("reject_rule").count().collect()}
    receipt: WriteReceipt = store.write(accepted, run_id=run_id)
    report.written, report.skipped = receipt.rows_written, receipt.rows_skipped
    return report


def ingest(spark: SparkSession, settings: Settings, *, mode: str = "live", store: SignalStore | None = None, guard: Guard | None = None, only: str | None = None, clock: Callable[[], int] = time.time_ns) -> list[AdapterReport]:
    chosen = [a for a in settings.adapters if a.enabled and only in (None, a.id)]
    if not chosen:
        raise IngestError(f"no adapter {only or ''} is set up")
    if mode == "backfill" and settings.window is None:
        raise IngestError("a backfill needs [backfill] start and end")
    store, guard = store or SignalStore(spark, settings.store_path), guard or Guard()
    mapping = reference.mapping(spark, settings.resolver_path) if settings.resolver_path else None
    out, limiters = [], {}
    for a in chosen:
        source = get_adapter(a.id)
        limiter = limiter_of(settings, a, limiters)
        if source.manifest.network and limiter is None:
            raise IngestError(f"{a.id} uses the network and has no [rate_limits.{a.limited_by}]")
        waited = limiter.waited_seconds if limiter else 0.0
        config = {**a.config, "limiter": limiter} if source.manifest.network else a.config
        out.append(_one(spark, settings, replace(a, config=config), source, mode, store, guard, clock(), mapping))
        out[-1].throttled_seconds = (limiter.waited_seconds if limiter else 0.0) - waited
    return out


def _one(spark, settings: Settings, a: AdapterSettings, source, mode: str, store: SignalStore, guard: Guard, now_ns: int, mapping: DataFrame | None) -> AdapterReport:
    def sink(rows: DataFrame) -> AdapterReport:
        return ingest_rows(rows, store=store, guard=guard, manifest=source.manifest, mode=mode, run_id=settings.run_id, now_ns=now_ns, mapping=mapping, kind=a.entity_kind, floor=settings.resolver_floor)

    read = lambda: source.read(spark, a.config, settings.run_id)
    if mode == "backfill":
        start, end = settings.window
        return sink(read().where((F.col("event_time_ns") >= start) & (F.col("event_time_ns") < end)))
    poller = Poller(read, sink, f"{settings.store_path}/_polls/{a.id}.json")
    return poller.poll(now_ns=now_ns) or AdapterReport(a.id)


def format_report(reports: list[AdapterReport], settings: Settings | None = None) -> str:
    """The run, its resolver tables, a line per adapter and per broken rule, and the totals."""
    lines = []
    if settings is not None:
        lines.append(f"run {settings.run_id} into {settings.store_path}")
        if settings.resolver_path:
            lines.append(f"resolver tables: {settings.resolver_version}")
    for r in reports:
        waited = f", throttled {r.throttled_seconds:.1f} s" if r.throttled_seconds else ""
        lines.append(f"{r.adapter_id}: {r.written} written, {r.skipped} skipped, {r.resolved} resolved, {r.unresolved} unresolved{waited}")
        lines += [f"  REJECTED [{rule}] {r.adapter_id}: {n} rows" for rule, n in sorted(r.rejected.items())]
    lines.append(f"total: {sum(r.written for r in reports)} written, {sum(r.skipped for r in reports)} skipped, {sum(sum(r.rejected.values()) for r in reports)} rejected")
    return "\n".join(lines)
