"""Reranking at scale, and what belongs to it, on Spark."""

from importlib import import_module

#: Where the names of the package are from; imported when asked for, as workers import the package too.
_HOME = {
    "rankloom.api": ("Pipeline", "Reranker", "Result", "load"),
    "rankloom.config": ("BatchConfig", "CanaryConfig", "CascadeConfig", "DriftConfig", "FusionConfig", "ModelConfig", "RerankConfig"),
    "rankloom.errors": ("RankError",),
}
__all__ = sorted(name for names in _HOME.values() for name in names)


def __getattr__(name: str):
    for module, names in _HOME.items():
        if name in names:
            return getattr(import_module(module), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
