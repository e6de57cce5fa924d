"""Vector arithmetic over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The unit vector; a zero vector stays zero."""
    size = F.greatest(norm(a), F.lit(FLOOR))
    return F.transform(F.array(size), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def literal(values) -> Column:
    """A query vector as one constant."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def mean_of(parts: list[Column]) -> Column:
    """The mean of those parts that aren't null."""
    present = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(F.size(present), F.lit(0))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` within the bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))
