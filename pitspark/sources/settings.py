"""Research settings and adapter manifests in TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from pathlib import Path
from typing import Any

from pitspark.operators.guard import Manifest
from pitspark.times import to_ns


class SettingsError(ValueError):
    """A settings file is not usable."""


@dataclass(frozen=True)
class AdapterSettings:
    id: str
    entity_kind: str = "ticker"
    config: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True
    #: Adapters of one provider share its rate limit; empty: the adapter is its own.
    provider: str = ""

    @property
    def limited_by(self) -> str:
        return self.provider or self.id


@dataclass(frozen=True)
class RateLimit:
    requests_per_second: float
    burst: int = 1


@dataclass(frozen=True)
class Settings:
    run_id: str
    store_path: str
    seed: int = 0
    resolver_path: str | None = None
    resolver_version: str = "v0"
    resolver_floor: float = 0.0
    window: tuple[int, int] | None = None
    rate_limits: dict[str, RateLimit] = field(default_factory=dict)
    adapters: tuple[AdapterSettings, ...] = ()

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        path = Path(path)
        try:
            return cls.parse(tomllib.loads(path.read_text()), base=path.parent)
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise SettingsError(f"{path}: {e}") from e

    @classmethod
    def parse(cls, data: dict[str, Any], *, base: Path) -> Settings:
        """Paths are relative to ``base``; in an adapter's config that is every key that ends in _path."""

        def need(table: str, key: str) -> Any:
            try:
                return data[table][key]
            except (KeyError, TypeError):
                raise SettingsError(f"[{table}] needs {key}") from None

        at = lambda p: str(p if Path(p).is_absolute() else base / p)
        window = None
        if "backfill" in data:
            window = tuple(_moment(need("backfill", k)) for k in ("start", "end"))
            if window[1] <= window[0]:
                raise SettingsError("[backfill] ends before it starts")
        adapters = []
        for a in data.get("adapters", []):
            if not a.get("id"):
                raise SettingsError("every [[adapters]] needs an id")
            config = {k: at(v) if k.endswith("_path") and isinstance(v, str) else v for k, v in a.get("config", {}).items()}
            adapters.append(AdapterSettings(a["id"], a.get("entity_kind", "ticker"), config, a.get("enabled", True), str(a.get("provider", ""))))
        if len({a.id for a in adapters}) < len(adapters):
            raise SettingsError("an adapter is listed twice")
        limits = {}
        for name, x in data.get("rate_limits", {}).items():
            limits[name] = RateLimit(float(x["requests_per_second"]), int(x.get("burst", 1)))
            if limits[name].requests_per_second <= 0 or limits[name].burst < 1:
                raise SettingsError(f"[rate_limits.{name}] must be positive")
        resolver = data.get("resolver", {})
        floor = float(resolver.get("floor", 0.0))
        if not 0 <= floor <= 1:
            raise SettingsError("[resolver] floor is between 0 and 1")
        tables = resolver.get("tables")
        return cls(need("run", "id"), at(need("store", "path")), int(data["run"].get("seed", 0)), at(tables) if tables else None, resolver.get("version", "v0"), floor, window, limits, tuple(adapters))


def _moment(x: str | date | datetime) -> int:
    if isinstance(x, str):
        x = datetime.fromisoformat(x)
    elif not isinstance(x, datetime):
        x = datetime(x.year, x.month, x.day)
    return to_ns(x if x.tzinfo else x.replace(tzinfo=UTC))


def load_manifest(path: str | Path) -> Manifest:
    data = tomllib.loads(Path(path).read_text())
    try:
        a, p = data["adapter"], data["pit"]
        return Manifest(a["id"], a.get("source_id", a["id"]), p["knowledge_time_basis"], bool(p.get("supports_restatement", False)), a.get("license_tag", "public"), bool(a.get("network", False)))
    except KeyError as e:
        raise SettingsError(f"{path} needs {e}") from None
