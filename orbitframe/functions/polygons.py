"""Polygons as arrays of rings, each an array of [x, y], as :func:`spatial.wkt_rings` and GeoJSON have them.

Rings may be closed or open, convex or concave; further rings are holes (a point is inside if a ray from it crosses the rings an odd number of times).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(rings: Column) -> Column:
    """All rings' edges as ``struct<ax, ay, bx, by>``; a ring's last point is joined to its first."""

    def of_ring(ring: Column) -> Column:
        n = F.size(ring)
        corner = lambda i, k: F.get(F.get(ring, i), F.lit(k))
        after = lambda i: F.when(i + 1 < n, i + 1).otherwise(F.lit(0))
        edge = lambda i: F.struct(corner(i, 0).alias("ax"), corner(i, 1).alias("ay"), corner(after(i), 0).alias("bx"), corner(after(i), 1).alias("by"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), edge)).otherwise(F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>"))

    return F.flatten(F.transform(rings, of_ring))


def _side(e: Column, x: Column, y: Column) -> Column:
    """On which side of the edge's line a point is: 1, 0 or -1."""
    return F.signum((e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"]))


def edges_cross(e: Column, f: Column) -> Column:
    """Closed segments meet: their boxes do, and neither lies on one side of the other."""
    over = lambda a, b: (F.least(e[a], e[b]) <= F.greatest(f[a], f[b])) & (F.least(f[a], f[b]) <= F.greatest(e[a], e[b]))
    apart = lambda g, h: _side(g, h["ax"], h["ay"]) * _side(g, h["bx"], h["by"]) <= 0
    return over("ax", "bx") & over("ay", "by") & apart(f, e) & apart(e, f)


def inside(x: Column, y: Column, around: Column) -> Column:
    """Whether a point that is on none of the edges ``around`` is within them."""
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & F.when(e["ay"] != e["by"], x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]).otherwise(False)
    return F.size(F.filter(around, crosses)) % 2 == 1


def edges_meet(a: Column, b: Column) -> Column:
    """Whether two polygons, given by their edges, have a point in common, their edges included; empty ones meet nothing."""
    touch = F.exists(a, lambda e: F.exists(b, lambda f: edges_cross(e, f)))
    first = lambda s, other: F.coalesce(inside(F.get(s, 0)["ax"], F.get(s, 0)["ay"], other), F.lit(False))
    return touch | first(a, b) | first(b, a)


def polygons_meet(a: Column, b: Column) -> Column:
    """:func:`edges_meet` of two polygons."""
    both = F.array(F.struct(edges(a).alias("a"), edges(b).alias("b")))
    return F.transform(both, lambda s: edges_meet(s["a"], s["b"]))[0]


def bounds(rings: Column) -> Column:
    """``struct<min_x, min_y, max_x, max_y>`` of all rings."""
    points = F.flatten(rings)
    axis = lambda k: F.transform(points, lambda p: p[k])
    return F.struct(F.array_min(axis(0)).alias("min_x"), F.array_min(axis(1)).alias("min_y"), F.array_max(axis(0)).alias("max_x"), F.array_max(axis(1)).alias("max_y"))
