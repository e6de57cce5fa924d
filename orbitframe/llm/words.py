"""Words and word shingles as Column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .runtime import let

#: Fixed: the characters between words.
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; none for null and empty texts."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner != "", F.split(inner, r"[\x20\x09-\x0D]+", -1)).otherwise(F.array().cast("array<string>"))


def hashes(items: Column) -> Column:
    return F.transform(items, lambda w: F.xxhash64(w))


def shingles(hashed: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` of the hashed words, in place order; none if there are fewer words."""
    run = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))
    return F.when(F.size(hashed) >= width, run).otherwise(F.array().cast("array<bigint>"))
