"""Descriptors and texts as vectors of one space, by a fixed random projection.

The projection is a constant of 16 x dim numbers made from a seed; applying it is a Column expression.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.text import CONCEPTS
from ..functions.vectors import dot, literal, normalised
from .pixels import CENTRE, DESCRIPTOR, SCALE

# Where each concept lies in the descriptor's standardised space.
PROTOTYPES = {
    "built structures": {"built_frac": 2.0, "edge_density": 1.5, "brightness": 1.0, "ndvi": -1.2, "texture": 0.8, "bright_frac": 1.0, "veg_frac": -1.0},
    "water": {"ndwi": 2.5, "water_frac": 2.5, "brightness": -1.0, "dark_frac": 1.2, "nir": -1.5, "ndvi": -1.0, "texture": -0.8},
    "vegetation": {"ndvi": 2.0, "veg_frac": 1.8, "nir": 1.5, "brightness": -0.3, "red": -0.8},
    "road": {"linearity": 2.5, "edge_density": 1.0, "built_frac": 0.8, "ndvi": -0.4},
    "bare soil": {"brightness": 1.3, "ndvi": -1.5, "veg_frac": -1.5, "red": 1.2, "texture": 0.3},
    "snow": {"brightness": 3.0, "bright_frac": 3.0, "contrast": -0.5, "blue": 2.5},
    "cloud": {"brightness": 2.5, "bright_frac": 2.5},
    "vessel": {"water_frac": 1.5, "ndwi": 1.2, "edge_density": 1.0, "built_frac": 0.6},
    "aircraft": {"linearity": 1.5, "built_frac": 1.5, "brightness": 1.0, "edge_density": 1.0},
}


def projection(dim: int = DEFAULTS.embedding_dim, seed: int = DEFAULTS.embedding_seed) -> np.ndarray:
    """The fixed matrix, one row a descriptor value."""
    return np.random.default_rng(seed).standard_normal((len(DESCRIPTOR), dim)).astype(np.float32) / np.sqrt(dim)


def standardised(descriptor: Column) -> Column:
    return F.zip_with(F.zip_with(descriptor, literal(CENTRE), lambda x, c: x - c), literal(SCALE), lambda x, s: x / s)


def encode_descriptors(rows: DataFrame, dim: int = DEFAULTS.embedding_dim, seed: int = DEFAULTS.embedding_seed) -> DataFrame:
    """``rows(tile_id, descriptor)`` to ``(tile_id, vector)``, unit vectors of floats."""
    columns = projection(dim, seed).T
    z = rows.select("tile_id", standardised(F.col("descriptor")).alias("z"))
    matrix = F.from_json(F.lit("[" + ",".join("[" + ",".join(repr(float(v)) for v in c) + "]" for c in columns) + "]"), "array<array<double>>")
    return z.select("tile_id", normalised(F.transform(matrix, lambda c: dot(F.col("z"), c))).cast("array<float>").alias("vector"))


def encode_text(text: str, dim: int = DEFAULTS.embedding_dim, seed: int = DEFAULTS.embedding_seed) -> list[float]:
    """A query text's vector: the prototypes of its concepts, and a small seeded part for each word."""
    lowered, place = text.lower(), {n: i for i, n in enumerate(DESCRIPTOR)}
    z, known = np.zeros(len(DESCRIPTOR), dtype=np.float32), False
    for concept, words in CONCEPTS.items():
        hits = sum(bool(re.search(rf"\b{w}\b", lowered)) for w in words)
        for name, value in PROTOTYPES[concept].items() if hits else ():
            z[place[name]] += np.float32(value) * np.float32(1 + 0.25 * (hits - 1))
        known = known or bool(hits)
    for word in re.findall(r"[a-z]{3,}", lowered):
        part = np.random.default_rng(int(hashlib.sha256(word.encode()).hexdigest()[:8], 16))
        z += part.standard_normal(len(DESCRIPTOR)).astype(np.float32) * np.float32(0.05 if known else 0.5)
    v = z @ projection(dim, seed)
    return (v / max(float(np.linalg.norm(v)), 1e-12)).tolist()
