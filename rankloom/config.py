"""Configurations, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from rankloom.errors import ConfigError


@dataclass(frozen=True)
class Device:
    kind: str = "cpu"
    ordinal: int = 0


@dataclass(frozen=True)
class FusionConfig:
    """``weights`` by list; a list beyond them weighs 1."""

    k: float = 60.0
    weights: tuple[float, ...] = (1.0,)

    def weight(self, list_id: int) -> float:
        return self.weights[list_id] if list_id < len(self.weights) else 1.0


@dataclass(frozen=True)
class CascadeConfig:
    """Fast scores of ``high`` and above stay; of ``low`` and above are scored again; others go."""

    high: float = 0.85
    low: float = 0.15

    def __post_init__(self):
        if not self.high > self.low:
            raise ConfigError(f"the high threshold ({self.high}) must exceed the low one ({self.low})")


@dataclass(frozen=True)
class ModelConfig:
    model_id: str = ""
    precision: str = "FP32"
    device: Device = field(default_factory=Device)
    scorer_type: str = "CrossEncoder"
    max_length: int = 128


@dataclass(frozen=True)
class RerankConfig:
    batch_size: int = 64
    max_length: int = 512
    normalize_scores: bool = True


@dataclass(frozen=True)
class DriftConfig:
    """``threshold`` of the divergence; ``warm_up`` observations make the baseline; below ``least`` nothing is said."""

    threshold: float = 0.5
    warm_up: int = 1000
    least: int = 50
    decay: float = 0.99
    bins: int = 100
    critical_after: int = 5
    epsilon: float = 1e-10


@dataclass(frozen=True)
class CanaryConfig:
    stages: tuple[int, ...] = (1, 5, 25, 100)
    observation_seconds: float = 300.0
    tolerance: float = 1.2


@dataclass(frozen=True)
class BatchConfig:
    max_batch: int = 32
    max_wait_seconds: float = 0.010

    def __post_init__(self):
        if self.max_batch < 1 or self.max_wait_seconds < 0:
            raise ConfigError("a batch needs room for a request and a wait that is not negative")
