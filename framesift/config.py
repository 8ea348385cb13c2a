"""Settings of a run, checked when made; from keyword arguments, JSON or YAML."""

from __future__ import annotations

import dataclasses as dc
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass
class PipelineSettings:
    mode: str = "batch"
    concurrency: int = 4

    def __post_init__(self) -> None:
        _need(self.mode in ("batch", "stream"), "pipeline.mode must be batch or stream")
        _need(self.concurrency >= 1, "pipeline.concurrency must be at least 1")


@dataclass
class MaskingSettings:
    block_size: int = 32
    window_size: int = 15
    noise_threshold: float = 0.8

    def __post_init__(self) -> None:
        _need(self.block_size > 0 and self.window_size > 0, "masking sizes must be positive")
        _need(0 <= self.noise_threshold <= 1, "masking.noise_threshold must be within 0 and 1")


@dataclass
class HasherSettings:
    algorithm: str = "phash"
    hash_size: int = 8
    tile_aspect_ratio: float = 1.5

    def __post_init__(self) -> None:
        _need(self.algorithm == "phash", "hasher.algorithm must be phash")
        _need(self.hash_size > 0 and self.tile_aspect_ratio > 0, "hasher sizes must be positive")


@dataclass
class ComparatorSettings:
    ssim_threshold: float = 0.85
    min_changed_pct: float = 2.0
    min_changed_blocks: int = 3

    def __post_init__(self) -> None:
        _need(0 <= self.ssim_threshold <= 1, "comparator.ssim_threshold must be within 0 and 1")
        _need(self.min_changed_pct >= 0 and self.min_changed_blocks >= 0, "comparator minima must not be negative")


@dataclass
class RedactorSettings:
    enabled: bool = True
    pii_types: list[str] = field(default_factory=lambda: ["email", "phone", "ssn", "credit_card", "ip_address", "address"])
    custom_patterns_file: str | None = None
    scope: str = "changed"

    def __post_init__(self) -> None:
        _need(self.scope in ("changed", "full"), "redactor.scope must be changed or full")


@dataclass
class ExporterSettings:
    output_dir: str = "./output"
    keyframe_format: str = "png"
    parquet_compression: str = "snappy"

    def __post_init__(self) -> None:
        _need(self.keyframe_format in ("png", "jpg"), "exporter.keyframe_format must be png or jpg")
        _need(self.parquet_compression in ("snappy", "gzip", "zstd", "none"), "exporter.parquet_compression is unknown")


@dataclass
class InputSettings:
    supported_formats: list[str] = field(default_factory=lambda: ["png", "jpg", "jpeg", "bmp", "tiff", "webp", "pdf"])
    sort_by: str = "filename"

    def __post_init__(self) -> None:
        _need(self.sort_by in ("filename", "timestamp"), "input.sort_by must be filename or timestamp")


@dataclass
class VideoSettings:
    sample_fps: float = 1.0
    formats: list[str] = field(default_factory=lambda: ["mp4", "mov", "webm"])
    audio_detection: bool = True
    transcript_path: str | None = None

    def __post_init__(self) -> None:
        _need(self.sample_fps > 0, "video.sample_fps must be positive")


@dataclass
class Settings:
    pipeline: PipelineSettings = field(default_factory=PipelineSettings)
    masking: MaskingSettings = field(default_factory=MaskingSettings)
    hasher: HasherSettings = field(default_factory=HasherSettings)
    comparator: ComparatorSettings = field(default_factory=ComparatorSettings)
    redactor: RedactorSettings = field(default_factory=RedactorSettings)
    exporter: ExporterSettings = field(default_factory=ExporterSettings)
    input: InputSettings = field(default_factory=InputSettings)
    video: VideoSettings = field(default_factory=VideoSettings)

    @classmethod
    def of(cls, values: dict[str, Any] | None) -> Settings:
        kinds = {f.name: f.default_factory for f in dc.fields(cls)}
        values = values or {}
        unknown = set(values) - set(kinds)
        _need(not unknown, f"unknown sections: {sorted(unknown)}")
        return cls(**{k: kinds[k](**(v or {})) for k, v in values.items()})


def _parsed(path: str | Path) -> Any:
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(f"no such file: {p}")
    if p.suffix.lower() in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(p.read_text())
    return json.loads(p.read_text())


def load_settings(path: str | Path | None = None) -> Settings:
    """None: defaults. YAML by suffix, else JSON; an empty YAML file: defaults."""
    return Settings() if path is None else Settings.of(_parsed(path))
