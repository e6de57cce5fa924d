"""Component scores of a search and their weighted rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import clip, mean_of

COMPONENTS = ("semantic", "quality", "change", "metadata", "spatial", "temporal")
#: Fixed: which context words ask for which tile feature, and from what value on it counts fully.
CONTEXT_FEATURES = {
    "water_frac": (["water", "river", "rivers", "lake", "lakes", "reservoir", "sea", "coast", "coastline", "shoreline", "pond", "canal", "wetland"], 0.02),
    "veg_frac": (["vegetation", "forest", "forests", "trees", "crop", "crops", "farmland", "field", "fields"], 0.02),
    "built_frac": (["building", "buildings", "urban", "settlement", "town", "city"], 0.02),
    "linearity": (["road", "roads", "highway", "railway", "runway"], 0.4),
}


def context_score(value: Column, least: float) -> Column:
    v = F.coalesce(value, F.lit(0.0))
    return F.when(v >= least, F.lit(1.0)).otherwise(clip(v / least) * 0.5)


def metadata_score(sensor: str | None = None, platform: str | None = None, context: list[str] | None = None, features: str = "features") -> Column:
    """The mean of sensor and platform matches, clearness, valid share, and asked context features."""
    same = lambda c, v: (F.lower(F.coalesce(F.col(c), F.lit(""))) == v.lower()).cast("double")
    parts = [same("sensor", sensor)] if sensor else []
    parts += [same("platform", platform)] if platform else []
    parts.append(clip(1 - F.coalesce("cloud_percentage", F.lit(0.0)) / 100))
    parts.append(clip(F.coalesce("valid_pixel_percentage", F.lit(0.0)) / 100))
    asked = set(context or [])
    parts += [context_score(F.element_at(features, name), least) for name, (words, least) in CONTEXT_FEATURES.items() if asked & set(words)]
    return mean_of(parts)


def final_score(weights: dict[str, float], applicable: list[str], scores: dict[str, Column], penalty: Column | None = None) -> Column:
    """Weighted mean over applicable components with a weight, less the penalty; the semantic score where there are none."""
    used = [c for c in COMPONENTS if c in applicable and weights.get(c, 0) > 0]
    if not used:
        return F.coalesce(scores["semantic"], F.lit(0.0))
    total = sum(weights[c] for c in used)
    mean = reduce(lambda a, b: a + b, [F.coalesce(scores[c], F.lit(0.0)) * weights[c] for c in used]) / total
    return mean * (1 - (F.lit(0.0) if penalty is None else F.coalesce(penalty, F.lit(0.0))))


def confidence(final: Column, applicable: list[str], scores: dict[str, Column]) -> Column:
    """Half the final score, half the weakest of the key components."""
    keys = [F.coalesce(scores[c], F.lit(0.0)) for c in ("semantic", "quality", "change") if c in applicable]
    weakest = final if not keys else keys[0] if len(keys) == 1 else F.least(*keys)
    return 0.5 * final + 0.5 * weakest


def reject_penalty(rejects: Column, weight: float, most: float = 0.9) -> Column:
    return F.least(F.lit(most), rejects * weight) if weight > 0 else F.lit(0.0)
