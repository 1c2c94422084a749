"""Guards and reports of a backtest. The simulation itself is not part of this library."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import date
from hashlib import sha256
from typing import Any


class BacktestError(ValueError):
    """A safeguard is off without saying so, or a report promises returns."""


@dataclass(frozen=True)
class BacktestSpec:
    factor_id: str
    universe_id: str
    snapshot_hash: str
    start: date
    end: date
    embargo: str = "1d"
    seed: int = 0
    fill_at: str = "next_open"
    max_participation: float = 0.1
    costs_enabled: bool = True
    label_gross_illustrative: bool = False
    delisting_handling_enabled: bool = True

    def __post_init__(self) -> None:
        gross = not self.costs_enabled
        if gross and not self.label_gross_illustrative:
            raise BacktestError("results before costs must be labelled as gross and illustrative")
        if not self.delisting_handling_enabled:
            raise BacktestError("delisted positions always count")
        if self.fill_at not in ("next_open", "next_vwap"):
            raise BacktestError("fills happen at the next bar")


def run_backtest(spec: BacktestSpec) -> None:
    raise NotImplementedError("this library doesn't simulate trades")


@dataclass(frozen=True)
class Stamp:
    """The inputs that identify a repeatable run."""

    snapshot_hash: str
    definition_hash: str = ""
    universe_id: str = ""
    cost_model_id: str = ""
    seed: int = 0
    code_version: str = ""


@dataclass(frozen=True)
class RunManifest(Stamp):
    """A stamp and the run that it belongs to."""

    run_id: str = ""
    parameters: dict[str, Any] = field(default_factory=dict)

    @property
    def hash(self) -> str:
        return content_hash(asdict(self))


def content_hash(value: Any) -> str:
    return sha256(json.dumps(value, default=str, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Scorecard:
    pit_universe_used: bool
    costs_enabled: bool
    no_whole_sample_normalization: bool
    delisting_handling_on: bool
    leakage_suite_passed: bool
    gross_illustrative: bool = False


@dataclass(frozen=True)
class Report:
    title: str
    scorecard: Scorecard
    stamp: Stamp | dict[str, str]
    diagnostics: dict[str, Any] = field(default_factory=dict)
    notes: tuple[str, ...] = ()
    baseline: str | None = None
    caveats: tuple[str, ...] = ("Diagnostics describe the past of a hypothesis and are no advice.",)


#: Words that promise what a diagnostic can't.
PROMISES = ("guaranteed", "alpha", "edge over the market", "expected return")


def assert_honest(text: str) -> None:
    low = text.lower()
    if found := [p for p in PROMISES if p in low]:
        raise BacktestError(f"the report promises returns: {', '.join(found)}")


def render_markdown(report: Report) -> str:
    lines = [f"# {report.title}", ""]
    if report.scorecard.gross_illustrative:
        lines += ["**Gross of costs, illustrative only.**", ""]
    lines += ["## Safeguards", "", *(f"- {k.replace('_', ' ')}: {'pass' if v else 'FAIL'}" for k, v in asdict(report.scorecard).items() if k != "gross_illustrative"), ""]
    stamp = asdict(report.stamp) if isinstance(report.stamp, Stamp) else report.stamp
    lines += ["## Diagnostics", "", f"- baseline: {report.baseline or 'none'}", *(f"- {k}: {v}" for k, v in sorted(report.diagnostics.items())), ""]
    lines += ["## Reproduction", "", *(f"- {k}: `{v}`" for k, v in sorted(stamp.items())), "", *report.notes]
    lines += ["", "## Caveats", "", *(f"- {c}" for c in report.caveats)]
    text = "\n".join(lines).rstrip() + "\n"
    assert_honest(text)
    return text
