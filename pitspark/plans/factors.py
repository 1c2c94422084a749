"""Factors: a YAML definition becomes one plan for all rebalance dates."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from datetime import date
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark import schema
from pitspark.functions.scalar import DAY_NS, payload_number, payload_text
from pitspark.operators import pit, transforms
from pitspark.operators.store import SnapshotStore


class FactorError(ValueError):
    """A definition is invalid, or can't be built on a snapshot."""


def days(text: str) -> int:
    """``5d``: calendar days."""
    if not (m := re.fullmatch(r"(\d+)d", str(text))):
        raise FactorError(f"{text!r} is no number of days such as 5d")
    return int(m[1])


@dataclass(frozen=True)
class Input:
    signal: str | None = None
    market: str | None = None
    series_id: str | None = None
    min_coverage: int | None = None
    window: str | None = None
    field: str | None = None

    def __post_init__(self) -> None:
        if bool(self.signal) == bool(self.market):
            raise FactorError("an input names a signal or a market, one of them")
        if self.min_coverage is not None and self.min_coverage < 1:
            raise FactorError("min_coverage is at least 1")
        if self.window is not None:
            days(self.window)

    @property
    def signal_type(self) -> str:
        return self.signal or self.market

    @property
    def reads(self) -> str | None:
        return self.field or schema.DEFAULT_FIELD.get(self.signal_type)


@dataclass(frozen=True)
class Definition:
    id: str
    version: str
    family: str
    description: str = ""
    inputs: tuple[Input, ...] = ()
    embargo: str = "1d"
    steps: tuple[tuple[str, dict[str, Any]], ...] = ()
    evaluation: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def parse(cls, data: Mapping) -> Definition:
        try:
            head, rule = data["factor"], data.get("pit", {})
            if rule.get("as_of_rule", "knowledge_time") != "knowledge_time":
                raise FactorError("pit.as_of_rule: rows can only be selected by knowledge_time")
            known = {f for f in Input.__dataclass_fields__}
            inputs = tuple(Input(**{k: v for k, v in x.items() if k in known}) for x in data.get("inputs", []))
            steps = tuple((s["op"], {k: v for k, v in s.items() if k != "op"}) for s in data.get("transform", []))
            out = cls(head["id"], str(head["version"]), head["family"], str(head.get("description", "")).strip(), inputs, rule.get("embargo", "1d"), steps, dict(data.get("evaluation", {})))
        except (KeyError, TypeError, AttributeError) as e:
            raise FactorError(f"not a factor definition: {e!r}") from e
        days(out.embargo)
        return out

    @property
    def hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()


def load_factor(path: str | Path) -> Definition:
    import yaml

    data = yaml.safe_load(Path(path).read_text())
    if not isinstance(data, dict):
        raise FactorError(f"{path} holds no mapping")
    return Definition.parse(data)


@dataclass(frozen=True)
class Panel:
    """Exposures (rebalance_date, entity, value) and what they come from. The hash covers definition, snapshot and dates."""

    exposures: DataFrame
    dates: DataFrame
    build_hash: str

    def diagnostics(self) -> DataFrame:
        return transforms.diagnostics(self.exposures, self.dates)


class Engine:
    def __init__(self, store: SnapshotStore, *, content_hash: str | None = None):
        if content_hash is not None and store.content_hash != content_hash:
            raise FactorError("the store is not the pinned snapshot")
        self.store, self.spark = store, store.spark

    def _in_force(self, spec: Input, cuts: DataFrame, value: Column, *also: str) -> DataFrame:
        """The value in force of each entity at each cut. Order matters: vintage, series, check of series, coverage, newest event."""
        rows = self.store.vintages(as_of_ns=self.store.as_of_ns).where(F.col("signal_type") == spec.signal_type)
        if spec.series_id is not None:
            # the series belongs to the key of a vintage, so this may come first
            rows = rows.where(F.col("series_id") == spec.series_id)
        read = pit.pit_read_dates(rows, cuts)
        if spec.series_id is None and (bad := pit.several_series(read, transforms.DATE, *also).first()):
            raise FactorError(f"{bad['entity']} has several series of {spec.signal_type}; the input must name one")
        if spec.min_coverage is not None:
            read = pit.covered(read, spec.min_coverage, F.coalesce(payload_number("sample_size"), payload_number("mention_count")))
        return pit.latest_in_force(read, value, transforms.DATE, *also).drop("event_time_ns")

    def build(self, definition: Definition, dates: Sequence[date]) -> Panel:
        if not definition.inputs:
            raise FactorError("the factor has no input")
        first, *others = definition.inputs
        for step, _ in definition.steps:
            transforms.get_op(step)
        rebalance = self.spark.createDataFrame([(d,) for d in sorted(set(dates))], f"{transforms.DATE} date")
        lag = days(definition.embargo)
        late = max(((d - date(1970, 1, 1)).days - lag for d in dates), default=0) * DAY_NS
        if late > self.store.as_of_ns:
            raise FactorError("a rebalance date lies beyond the snapshot")
        if any(op == "pct_change" for op, _ in definition.steps):
            if first.window is None:
                raise FactorError("pct_change needs a window on the first input")
            # values and their bases in one read
            cuts = [pit.embargoed_cuts(rebalance, lag + back).withColumn("back", F.lit(is_base)) for is_base, back in ((False, 0), (True, days(first.window)))]
            section = transforms.with_base(self._in_force(first, cuts[0].union(cuts[1]), payload_number(first.reads), "back"))
        else:
            section = self._in_force(first, pit.embargoed_cuts(rebalance, lag), payload_number(first.reads))
        labels = None
        for order, spec in enumerate(others):
            if not self._in_force(spec, pit.embargoed_cuts(rebalance, lag), payload_number(spec.reads)).isEmpty():
                raise FactorError("only the first input may be numeric")
            found = self._in_force(spec, pit.embargoed_cuts(rebalance, lag), payload_text(spec.reads)).withColumnRenamed("value", "label")
            found = found.withColumn("_order", F.lit(order))
            labels = found if labels is None else labels.unionByName(found)
        if labels is not None:
            # of several inputs that label an entity the last one counts
            labels = labels.groupBy(transforms.DATE, transforms.ENTITY).agg(F.max_by("label", "_order").alias("label"))
        for op, params in definition.steps:
            given: dict[str, Any] = dict(params)
            if op == "sector_neutralize" and "sectors" not in given:
                if labels is None:
                    raise FactorError("sector_neutralize needs an input of labels, or sectors")
                given["sectors"] = labels
            section = transforms.get_op(op)(section, **given)
        whole = {"definition": definition.hash, "snapshot": self.store.content_hash, "dates": sorted(str(d) for d in set(dates))}
        return Panel(section, rebalance, hashlib.sha256(json.dumps(whole, sort_keys=True).encode()).hexdigest())


def panel_json(panel: Panel) -> str:
    """Exposures and diagnostics of a panel that fits the driver, as the command line prints it."""
    exposures: dict[str, dict[str, float]] = {str(r[0]): {} for r in panel.dates.collect()}
    for r in panel.exposures.orderBy(transforms.DATE, transforms.ENTITY).collect():
        exposures[str(r["rebalance_date"])][r["entity"]] = r["value"]
    stats = {str(r["rebalance_date"]): {k: v for k, v in r.asDict().items() if k != "rebalance_date"} for r in panel.diagnostics().collect()}
    return json.dumps({"build_hash": panel.build_hash, "exposures": exposures, "diagnostics": stats}, indent=1, sort_keys=True)
