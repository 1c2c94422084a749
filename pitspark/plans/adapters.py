"""Sources by name. Packages may add their own under the entry point group ``pitspark.adapters``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.operators.guard import Manifest
from pitspark.sources import edgar, market, reference

GROUP = "pitspark.adapters"


class AdapterError(LookupError):
    """No such adapter, or one that doesn't load."""


@dataclass(frozen=True)
class Adapter:
    """``read(spark, config, run_id)`` gives all observations of a source."""

    manifest: Manifest
    read: Callable[[SparkSession, dict[str, Any], str], DataFrame]


_ADAPTERS: dict[str, Adapter] = {}


def register_adapter(adapter: Adapter) -> Adapter:
    if adapter.manifest.adapter_id in _ADAPTERS:
        raise AdapterError(f"{adapter.manifest.adapter_id} is registered already")
    _ADAPTERS[adapter.manifest.adapter_id] = adapter
    return adapter


def get_adapter(name: str) -> Adapter:
    if name in _ADAPTERS:
        return _ADAPTERS[name]
    for e in entry_points(group=GROUP):
        if e.name == name:
            return e.load()
    raise AdapterError(f"unknown adapter {name!r}; known: {', '.join(sorted(discover()))}")


def discover() -> dict[str, Manifest | str]:
    """Manifests of all adapters; of one that fails to load, the error."""
    found: dict[str, Manifest | str] = {k: a.manifest for k, a in _ADAPTERS.items()}
    for e in entry_points(group=GROUP):
        try:
            found[e.name] = e.load().manifest
        except Exception as error:  # one broken plugin must not hide the others
            found[e.name] = f"{type(error).__name__}: {error}"
    return found


def _market(spark: SparkSession, config: dict[str, Any], run_id: str) -> DataFrame:
    paths = {k: config.get(k) for k in ("bars_path", "corporate_actions_path", "delistings_path")}
    return market.MarketCsv(spark, **paths, close=config.get("session_close_utc", "21:00"), adjustment_ref=config.get("adjustment_ref"), source_id=config.get("source_id", "market_csv"), run_id=run_id).observations()


def _universe(spark: SparkSession, config: dict[str, Any], run_id: str) -> DataFrame:
    return reference.membership_observations(reference.memberships(spark, config["membership_path"]), universe=config["universe_id"], run_id=run_id)


def _filings(spark: SparkSession, config: dict[str, Any], run_id: str) -> DataFrame:
    """From landed JSON: one line per filer, with its number in ``cik``; ``history_path`` holds the older filing lists that a filer's file names, likewise."""
    older = spark.read.schema(f"cik string, {edgar.HISTORY}").json(config["history_path"]) if config.get("history_path") else None
    filed = edgar.filings(spark.read.schema(f"cik string, {edgar.SUBMISSIONS}").json(config["submissions_path"]), older, forms=config["forms"])
    stated = edgar.facts(spark.read.schema(f"cik string, {edgar.FACTS}").json(config["facts_path"]), filed, concepts=config["concepts"])
    rows = edgar.observations(filed, stated)
    return market.envelope(rows, adapter_id="sec_filings", source_id="sec_filings", suffix=F.concat_ws("|", "series_id", "vintage_id"), run_id=run_id)


register_adapter(Adapter(Manifest("market_csv", "market_csv"), _market))
register_adapter(Adapter(Manifest("universe_csv", "universe_csv", supports_restatement=True), _universe))
register_adapter(Adapter(Manifest("sec_filings", "sec_filings", supports_restatement=True), _filings))
