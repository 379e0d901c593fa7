"""Settings and project roots (S17, S18), read on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.impact import RiskConfig, validate_services

# Fixed values.
VERSION = "2.0"
NAMES = ("seamwright.config.json", ".seamwright.json")
PAIRS = (("frontend", "backend"), ("client", "server"), ("web", "api"), ("apps/web", "apps/api"))
_RISK = {"baseWeightBreaking": "breaking", "baseWeightUnknown": "unknown", "publicApiBonus": "public_bonus", "transitiveBlastRadiusThreshold": "transitive_threshold", "transitiveBlastRadiusBonus": "transitive_bonus"}


@dataclass(frozen=True)
class Config:
    client: str | None = None
    server: str | None = None
    service_name: str | None = None
    services: dict[str, dict] = field(default_factory=dict)
    risk: RiskConfig = field(default_factory=RiskConfig)
    sensitive: tuple[str, ...] = ()


def load(folder: str | Path) -> Config:
    """The first settings file of the folder; defaults without one."""
    path = next((p for n in NAMES if (p := Path(folder, n)).is_file()), None)
    if path is None:
        return Config()
    raw = json.loads(path.read_text())
    if raw.get("version", VERSION) != VERSION:
        raise ValueError(f"{path.name}: version {raw['version']} is not {VERSION}")
    services = raw.get("services", {})
    if wrong := validate_services(services):
        raise ValueError(f"{path.name}: " + "; ".join(wrong))
    given = raw.get("risk", {})
    levels = given.get("thresholds", {})
    base = RiskConfig()
    weights = {own: given[k] for k, own in _RISK.items() if k in given}
    multipliers = {**base.multipliers, **given.get("criticalityMultipliers", {})}
    risk = RiskConfig(**weights, multipliers=multipliers, levels=tuple(levels.get(k, x) for k, x in zip(("critical", "high", "medium"), base.levels, strict=True)))
    return Config(raw.get("client"), raw.get("server"), raw.get("serviceName"), services, risk, tuple(given.get("sensitiveFields", ())))


def project_roots(folder: str | Path) -> tuple[str, str] | None:
    """The first pair of client and server folders that exists."""
    return next(((str(Path(folder, c)), str(Path(folder, s))) for c, s in PAIRS if Path(folder, c).is_dir() and Path(folder, s).is_dir()), None)
