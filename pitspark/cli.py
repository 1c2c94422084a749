"""Command line: ingest, store, snapshot, universe, factor, adapters; backtest and report answer that they aren't there."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, date, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pitspark import __version__
from pitspark.operators import entities, inspect
from pitspark.operators.store import SignalStore, SnapshotStore
from pitspark.plans import adapters, factors, ingest
from pitspark.sources import reference
from pitspark.sources.settings import Settings
from pitspark.times import to_ns


def _moment(text: str) -> int:
    at = datetime.fromisoformat(text)
    return to_ns(at if at.tzinfo else at.replace(tzinfo=UTC))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pitspark", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "store", "snapshot", "universe"):
        sub.add_parser(name).add_argument("--config", required=True)
    sub.choices["ingest"].add_argument("--adapter")
    sub.choices["ingest"].add_argument("--backfill", action="store_true")
    sub.choices["snapshot"].add_argument("--as-of", required=True)
    sub.choices["snapshot"].add_argument("--out", required=True)
    sub.choices["snapshot"].add_argument("--push")
    sub.choices["universe"].add_argument("--as-of", required=True)
    sub.choices["universe"].add_argument("--universe", required=True)
    f = sub.add_parser("factor")
    f.add_argument("definition")
    f.add_argument("--validate-only", action="store_true")
    f.add_argument("--snapshot")
    f.add_argument("--dates")
    f.add_argument("--out")
    sub.add_parser("adapters")
    for name in ("backtest", "report"):
        sub.add_parser(name)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a, rest = parser().parse_known_args(argv)
    if a.command in ("backtest", "report") or getattr(a, "push", None):
        print("not available", file=sys.stderr)
        return 2
    if rest:
        parser().error(f"unknown arguments {rest}")
    if a.command == "adapters":
        for name, manifest in sorted(adapters.discover().items()):
            print(f"{name}: {manifest if isinstance(manifest, str) else manifest.knowledge_time_basis}")
        return 0
    if a.command == "factor" and a.validate_only:
        print(factors.load_factor(a.definition).id, "is valid")
        return 0
    spark = spark or SparkSession.builder.appName("pitspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "factor":
        return _factor(a, spark)
    settings = Settings.load(a.config)
    if a.command == "ingest":
        reports = ingest.ingest(spark, settings, mode="backfill" if a.backfill else "live", only=a.adapter)
        print(ingest.format_report(reports, settings))
        return int(any(r.rejected for r in reports))
    if a.command == "store":
        print("\n".join(inspect.lines(SignalStore(spark, settings.store_path).audit())))
    elif a.command == "snapshot":
        ref = SignalStore(spark, settings.store_path).snapshot(as_of_ns=_moment(a.as_of), target_dir=a.out)
        print(ref.content_hash)
    else:
        found = [x for x in settings.adapters if x.config.get("universe_id") == a.universe]
        if not found:
            print(f"no universe {a.universe}", file=sys.stderr)
            return 2
        intervals = reference.memberships(spark, found[0].config["membership_path"])
        for row in entities.members_as_of(intervals, F.lit(date.fromisoformat(a.as_of[:10]))).collect():
            print(row["entity"])
    return 0


def _factor(a: argparse.Namespace, spark: SparkSession) -> int:
    if not a.snapshot or not a.dates:
        print("a build needs --snapshot and --dates", file=sys.stderr)
        return 2
    panel = factors.Engine(SnapshotStore(spark, a.snapshot)).build(factors.load_factor(a.definition), [date.fromisoformat(x.strip()) for x in a.dates.split(",")])
    text = factors.panel_json(panel)
    if a.out:
        Path(a.out).write_text(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
