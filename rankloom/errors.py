"""Errors by category; each message begins with its category."""

from __future__ import annotations


class RankError(Exception):
    """Base of all errors raised here."""

    category = "rank"

    def __init__(self, message: str):
        super().__init__(f"{self.category} error: {message}")


def _category(name: str) -> type[RankError]:
    return type(f"{name.capitalize()}Error", (RankError,), {"category": name, "__doc__": f"An error of category {name}."})


ModelError, TokenizerError, InferenceError, DownloadError, CacheError, ConfigError, CalibrationError, IoError, SerializationError = map(
    _category, ("model", "tokenizer", "inference", "download", "cache", "config", "calibration", "io", "serialization")
)
