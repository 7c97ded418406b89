"""Names, devices and precisions: pure functions of the driver."""

from __future__ import annotations

import os
import time
from collections.abc import Mapping
from pathlib import Path

from rankloom.config import Device
from rankloom.errors import CacheError, ConfigError

PRECISIONS = ("fp32", "fp16", "int8", "int4")

#: File names of model variants in the order in which a device prefers them.
CPU_VARIANTS = ("model_qint8_avx512.onnx", "model_quint8_avx2.onnx", "model_O2.onnx", "model_O3.onnx", "model.onnx")
GPU_VARIANTS = ("model.onnx", "model_O2.onnx")


def parse_device(text: str) -> Device:
    """``cpu``, ``cuda[:N]`` or ``tensorrt[:N]``. A bad N is an error for cuda and 0 for tensorrt."""
    kind, colon, number = text.strip().lower().partition(":")
    if kind == "cpu" and not colon:
        return Device("cpu")
    if kind not in ("cuda", "tensorrt"):
        raise ConfigError(f"unknown device {text!r}")
    if not colon:
        return Device(kind)
    if number.isascii() and number.isdigit():
        return Device(kind, int(number))
    if kind == "tensorrt":
        return Device(kind)
    raise ConfigError(f"bad device number in {text!r}")


def parse_precision(text: str) -> str:
    if text not in PRECISIONS:
        raise ConfigError(f"unknown precision {text!r}")
    return text.upper()


def effective_precision(precision: str, has_calibration: bool) -> str:
    """Integer precisions need calibration data; without it, half floats are used."""
    return "FP16" if precision in ("INT8", "INT4") and not has_calibration else precision


def cache_folder(model_id: str) -> str:
    return "models--" + model_id.replace("/", "--")


def engine_name(arch: str, precision: str, version: str) -> str:
    return f"{arch}-{precision.lower()}-trt{version}.engine"


def epoch_text(seconds: int | None = None) -> str:
    return f"{int(time.time()) if seconds is None else seconds}s since epoch"


def cache_root(env: Mapping[str, str] | None = None) -> Path:
    """Where models are kept: HF_HOME, else below HOME or USERPROFILE, else below the working folder."""
    env = os.environ if env is None else env
    if env.get("HF_HOME"):
        return Path(env["HF_HOME"]) / "hub"
    home = env.get("HOME") or env.get("USERPROFILE")
    return (Path(home) if home else Path(".")) / ".cache" / "huggingface" / "hub"


def snapshot(root: Path, model_id: str) -> Path:
    """The newest snapshot of a cached model."""
    folder = root / cache_folder(model_id) / "snapshots"
    if not folder.is_dir():
        raise CacheError(f"{model_id} is not cached: it has no folder of snapshots")
    found = [p for p in folder.iterdir() if p.is_dir()]
    if not found:
        raise CacheError(f"{model_id} has no snapshot")
    return max(found, key=lambda p: (p.stat().st_mtime, p.name))


def model_file(folder: Path, device: Device) -> Path:
    """The variant that the device prefers among those that exist; the plain model's place if none does."""
    base = folder / "onnx" if (folder / "onnx").is_dir() else folder
    places = [base / name for name in (CPU_VARIANTS if device.kind == "cpu" else GPU_VARIANTS)] + [folder / "model.onnx"]
    return next((p for p in places if p.exists()), folder / "onnx" / "model.onnx")


def load_model(root: Path, model_id: str, device: Device) -> tuple[Path, Path]:
    """The files of model and tokenizer of a cached model; an error if one is missing."""
    folder = snapshot(root, model_id)
    model, tokenizer = model_file(folder, device), folder / "tokenizer.json"
    for path in (model, tokenizer):
        if not path.exists():
            raise CacheError(f"{model_id} lacks {path.name}")
    return model, tokenizer
