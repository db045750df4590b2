"""Configuration: dataclasses that reject unknown keys and values out of range."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any

METHODS = ("page_hinkley", "cusum")
DETECTORS = {
    "entropy": ("entropy_mean", "entropy_quantile", "entropy_pop_shift"),
    "divergence": ("kl_divergence", "js_divergence"),
    "embedding": ("embedding_mahalanobis_mean", "embedding_mean_shift", "embedding_cov_drift"),
}


def _only_known(cls, data: dict) -> dict:
    if not isinstance(data, dict):
        raise ValueError(f"{cls.__name__} needs a mapping")
    if extra := sorted(set(data) - {f.name for f in fields(cls)}):
        raise ValueError(f"unknown keys for {cls.__name__}: {', '.join(extra)}")
    return data


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class DetectorConfig:
    name: str
    enabled: bool = True
    params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        _need(self.name in DETECTORS, f"unknown detector: {self.name}")
        p = self.params
        _need(0 < p.get("quantile", 0.5) < 1, "quantile must lie between 0 and 1")
        _need(p.get("cov_every", 0) >= 0, "cov_every must not be negative")
        _need(0 < p.get("decay", 1.0) <= 1, "decay must lie in (0, 1]")


@dataclass(frozen=True)
class ThresholdConfig:
    threshold: float
    method: str = "page_hinkley"
    delta: float = 0.0
    debounce: int = 1
    cooldown: int = 0

    def __post_init__(self):
        _need(self.method in METHODS, f"unknown method: {self.method}")
        _need(self.threshold > 0, "threshold must be positive")
        _need(self.delta >= 0, "delta must not be negative")
        _need(self.debounce >= 1, "debounce must be at least 1")
        _need(self.cooldown >= 0, "cooldown must not be negative")


@dataclass(frozen=True)
class ExportConfig:
    enabled: bool = True
    namespace: str = "driftloom"
    port: int = 9300
    push_gateway_url: str | None = None

    def __post_init__(self):
        _need(1 <= self.port <= 65535, "port must lie between 1 and 65535")


@dataclass(frozen=True)
class Config:
    """``window_size`` and ``drain_every_k`` have to be given."""

    window_size: int
    drain_every_k: int
    enabled: bool = True
    detectors: tuple[DetectorConfig, ...] = ()
    thresholds: dict[str, ThresholdConfig] = field(default_factory=dict)
    export: ExportConfig = field(default_factory=ExportConfig)

    def __post_init__(self):
        _need(self.window_size > 0, "window_size must be positive")
        _need(self.drain_every_k > 0, "drain_every_k must be positive")
        names = [d.name for d in self.detectors]
        _need(len(names) == len(set(names)), "detector names must be unique")

    @classmethod
    def from_dict(cls, data: dict | None) -> Config:
        data = dict(_only_known(cls, {} if data is None else data))
        if missing := [k for k in ("window_size", "drain_every_k") if k not in data]:
            raise ValueError(f"{', '.join(missing)} must be given")
        if "detectors" in data:
            data["detectors"] = tuple(DetectorConfig(**_only_known(DetectorConfig, d)) for d in data["detectors"])
        if "thresholds" in data:
            data["thresholds"] = {k: ThresholdConfig(**_only_known(ThresholdConfig, v)) for k, v in data["thresholds"].items()}
        if "export" in data:
            data["export"] = ExportConfig(**_only_known(ExportConfig, data["export"]))
        return cls(**data)

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        import yaml

        return cls.from_dict(yaml.safe_load(text))

    def to_dict(self) -> dict:
        return asdict(self) | {"detectors": [asdict(d) for d in self.detectors]}

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.to_dict(), sort_keys=False)

    def active(self) -> list[DetectorConfig]:
        """Detectors that are built, in the given order."""
        return [d for d in self.detectors if d.enabled]
