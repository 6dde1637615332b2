"""Settings in frozen groups with checked ranges; a session's ``ledgerleaf.<group>.<name>`` overrides a default."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import SparkSession


def _bounded(default: float, least: float, most: float) -> Any:
    return field(default=default, metadata={"least": least, "most": most})


class _Checked:
    def __post_init__(self) -> None:
        for f in fields(self):  # type: ignore[arg-type]
            if "least" in f.metadata and not f.metadata["least"] <= getattr(self, f.name) <= f.metadata["most"]:
                raise ValueError(f"{type(self).__name__}.{f.name} must lie in [{f.metadata['least']}, {f.metadata['most']}]")


@dataclass(frozen=True)
class Chunking(_Checked):
    target: int = _bounded(512, 64, 8192)
    overlap: int = _bounded(50, 0, 1024)
    most: int = _bounded(1024, 64, 16384)
    small_table: int = _bounded(150, 0, 4096)
    similarity: float = _bounded(0.7, 0.0, 1.0)


@dataclass(frozen=True)
class Retrieval(_Checked):
    top_k: int = _bounded(5, 1, 1000)
    expanded_k: int = _bounded(10, 1, 1000)
    metric: str = "cosine"
    dimension: int = _bounded(384, 1, 65536)


@dataclass(frozen=True)
class Uncertainty(_Checked):
    expand_at: float = _bounded(1.5, 0.0, 20.0)
    abstain_at: float = _bounded(2.0, 0.0, 20.0)


@dataclass(frozen=True)
class Generation(_Checked):
    max_tokens: int = _bounded(512, 1, 32768)
    temperature: float = _bounded(0.1, 0.0, 2.0)
    top_p: float = _bounded(0.9, 0.0, 1.0)


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = Chunking()
    retrieval: Retrieval = Retrieval()
    uncertainty: Uncertainty = Uncertainty()
    generation: Generation = Generation()


def settings(spark: SparkSession) -> Settings:
    """The session's settings."""
    groups = {}
    for group in fields(Settings):
        kind = type(group.default)
        given = {}
        for f in fields(kind):
            raw = spark.conf.get(f"ledgerleaf.{group.name}.{f.name}", None)
            if raw is not None:
                given[f.name] = type(f.default)(raw)
        groups[group.name] = kind(**given)
    return Settings(**groups)
