"""The leakage guard: rules on stamps that every row passes before it is written."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = ("source", "ingestion", "provider_vintage")
RULES = ("future-knowledge", "backfill-now-stamp", "missing-provider-vintage", "missing-vintage")


@dataclass(frozen=True)
class Manifest:
    """What an adapter declares about its stamps."""

    adapter_id: str = "adapter"
    source_id: str = "source"
    knowledge_time_basis: str = "source"
    supports_restatement: bool = False
    license_tag: str = "public"
    network: bool = False

    def __post_init__(self) -> None:
        if self.knowledge_time_basis not in BASES:
            raise ValueError(f"knowledge_time_basis is one of {BASES}")


@dataclass(frozen=True)
class GuardPolicy:
    max_clock_skew: timedelta = timedelta(minutes=5)
    now_stamp_tolerance: timedelta = timedelta(hours=24)
    historical_event_age: timedelta = timedelta(days=7)


def _ns(span: timedelta) -> int:
    return span // timedelta(microseconds=1) * 1000


def reject_rule(*, now_ns: int | Column, mode: str, manifest: Manifest, policy: GuardPolicy | None = None) -> Column:
    """The first rule that a row breaks, in their order; null: none."""
    if mode not in ("backfill", "live"):
        raise ValueError("mode is backfill or live")
    policy = policy or GuardPolicy()
    now = F.lit(now_ns) if isinstance(now_ns, int) else now_ns
    known, event = F.col("knowledge_time_ns"), F.col("event_time_ns")
    bare = F.coalesce(F.col("vintage_id") == "", F.lit(True))
    basis = manifest.knowledge_time_basis
    tests = {
        RULES[0]: known > now + _ns(policy.max_clock_skew),
        RULES[1]: F.lit(mode == "backfill" and basis == "ingestion") & (now - event > _ns(policy.historical_event_age)) & (now - known < _ns(policy.now_stamp_tolerance)),
        RULES[2]: F.lit(basis == "provider_vintage") & bare,
        RULES[3]: F.lit(manifest.supports_restatement) & bare,
    }
    return F.coalesce(*(F.when(test, F.lit(rule)) for rule, test in tests.items()))


_PROOF = object()


class ValidatedFrame:
    """Rows that passed the guard. Only ``Guard.split`` makes one, and the store takes nothing else."""

    def __init__(self, rows: DataFrame, *, proof: object = None):
        if proof is not _PROOF:
            raise TypeError("only the guard validates rows")
        self.rows = rows


class Guard:
    def __init__(self, policy: GuardPolicy | None = None):
        self.policy = policy or GuardPolicy()

    def split(self, rows: DataFrame, *, manifest: Manifest, mode: str, now_ns: int) -> tuple[ValidatedFrame, DataFrame]:
        """Accepted rows, and rejected ones with their ``reject_rule``."""
        marked = rows.withColumn("reject_rule", reject_rule(now_ns=now_ns, mode=mode, manifest=manifest, policy=self.policy))
        return ValidatedFrame(marked.where("reject_rule IS NULL").drop("reject_rule"), proof=_PROOF), marked.where("reject_rule IS NOT NULL")
