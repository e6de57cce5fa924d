"""Defaults of the engine; every operator takes its values as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Tiling, gates, budgets and weights that results depend on.
    tile_size: int = 256
    min_valid_ratio: float = 0.2
    preprocessing_version: str = "preproc-1.0.0"
    embedding_dim: int = 256
    embedding_seed: int = 1337
    change_threshold: float = 0.15
    min_report_confidence: float = 0.2
    max_pairs_per_location: int = 6
    season_tolerance_days: int = 45
    max_change_locations: int = 50
    min_change_quality: float = 0.5
    cloud_bright: float = 0.75
    shadow_dark: float = 0.08
    pool_factor: int = 3
    reject_penalty: float = 0.0
    max_penalty: float = 0.9
    cluster_cap: int = 50_000
    cluster_representatives: int = 5
    weights: dict[str, float] = field(default_factory=lambda: {"semantic": 0.45, "quality": 0.15, "change": 0.20, "metadata": 0.10, "spatial": 0.10, "temporal": 0.0})


DEFAULTS = Settings()
