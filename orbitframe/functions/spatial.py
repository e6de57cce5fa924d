"""Boxes, grid cells and their text forms. Boxes are the columns min_x, min_y, max_x, max_y."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("min_x", "min_y", "max_x", "max_y")


def box_columns(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in BOX]


def overlaps(bbox: list[float], prefix: str = "") -> Column:
    """Closed boxes meet; four plain comparisons, so that they reach the Parquet scan."""
    x0, y0, x1, y1 = box_columns(prefix)
    return (x1 >= bbox[0]) & (x0 <= bbox[2]) & (y1 >= bbox[1]) & (y0 <= bbox[3])


def covered_fraction(bbox: list[float], prefix: str = "") -> Column:
    """The share of the row's box that lies in ``bbox``; 0 for null or empty boxes."""
    x0, y0, x1, y1 = box_columns(prefix)
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(x1, F.lit(float(bbox[2]))) - F.greatest(x0, F.lit(float(bbox[0]))))
    high = F.greatest(zero, F.least(y1, F.lit(float(bbox[3]))) - F.greatest(y0, F.lit(float(bbox[1]))))
    area = (x1 - x0) * (y1 - y0)
    return F.when(x0.isNotNull() & (area > 0), F.least(F.greatest(wide * high / F.nullif(area, zero), zero), F.lit(1.0))).otherwise(zero)


def box_struct(prefix: str = "") -> Column:
    """The box as an array, null if its first corner is."""
    return F.when(F.col(prefix + "min_x").isNotNull(), F.array(*box_columns(prefix)))


def wkt_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The box as a WKT polygon, counter-clockwise from its lower right corner."""
    corner = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    ring = F.concat_ws(", ", corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0), corner(x1, y0))
    return F.when(x0.isNotNull(), F.concat(F.lit("POLYGON (("), ring, F.lit("))")))


def wkt_rings(wkt: Column) -> Column:
    """The rings of a WKT polygon as arrays of [x, y]."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([-+0-9.eE ,]+)\)"), F.lit(1))
    point = lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda v: v.cast("double"))
    return F.transform(rings, lambda r: F.transform(F.split(r, ","), point))


def geojson(wkt: Column) -> Column:
    """A WKT polygon or point as GeoJSON text; null and empty texts give null."""
    kind = F.initcap(F.lower(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1)))
    point = F.to_json(F.struct(kind.alias("type"), F.get(F.get(wkt_rings(wkt), F.lit(0)), F.lit(0)).alias("coordinates")))
    polygon = F.to_json(F.struct(kind.alias("type"), wkt_rings(wkt).alias("coordinates")))
    return F.when(F.length(F.trim(wkt)) > 0, F.when(kind == "Point", point).otherwise(polygon))


def wkt_bounds(wkt: Column) -> Column:
    """``struct<min_x, min_y, max_x, max_y>`` of a WKT polygon."""
    points = F.flatten(wkt_rings(wkt))
    axis = lambda k: F.transform(points, lambda p: p[k])
    return F.struct(F.array_min(axis(0)).alias("min_x"), F.array_min(axis(1)).alias("min_y"), F.array_max(axis(0)).alias("max_x"), F.array_max(axis(1)).alias("max_y"))


def footprint(rows: tuple[Column, Column], cols: tuple[Column, Column], height: Column, width: Column, prefix: str = "") -> list[Column]:
    """The box of a pixel range (first, last) within the row's box; rows count from the top."""
    x0, y0, x1, y1 = box_columns(prefix)
    east = lambda c: x0 + (x1 - x0) * c / width
    south = lambda r: y1 - (y1 - y0) * r / height
    return [east(cols[0]), south(rows[1] + 1), east(cols[1] + 1), south(rows[0])]


def general_number(x: Column) -> Column:
    """A number in the style of C's %g: six significant digits, no trailing zeros."""
    size = F.floor(F.log10(F.abs(x)))
    digits = lambda v: F.regexp_replace(F.regexp_replace(v, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    scale = F.pow(F.lit(10.0), 5 - size)
    plain = digits(F.format_string("%.12f", F.bround(x * scale, 0) / scale))
    power = digits(F.format_string("%.5f", x / F.pow(F.lit(10.0), size)))
    sign = F.when(size < 0, F.lit("-")).otherwise(F.lit("+"))
    scientific = F.concat(power, F.lit("e"), sign, F.lpad(F.abs(size).cast("int").cast("string"), 2, "0"))
    return F.when(x == 0, F.lit("0")).when((size < -4) | (size >= 6), scientific).otherwise(plain)


def location_key(crs_key: Column, resolution: Column, tile_size: Column, gx: Column, gy: Column) -> Column:
    return F.concat_ws(":", crs_key, general_number(resolution), tile_size.cast("string"), gx.cast("string"), gy.cast("string"))


def crs_key(epsg: Column, crs: Column) -> Column:
    return F.coalesce(epsg.cast("string"), F.substring(F.sha1(crs), 1, 8))


def grid_cells(left: Column, bottom: Column, right: Column, top: Column, resolution: Column, tile_size: int) -> Column:
    """The cells that bounds touch on the grid anchored at the CRS origin: ``array<struct<gx, gy>>``, north to south, then west to east."""
    side = resolution * tile_size
    first = lambda v: F.floor(v / side)
    last = lambda v: F.ceil(v / side) - 1
    xs = F.sequence(first(left), last(right))
    ys = F.sequence(last(top), first(bottom), F.lit(-1).cast("long"))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("gx"), y.alias("gy")))))


#: Fixed: the WGS84 ellipsoid and the UTM projection.
A, E2, K0 = 6378137.0, 0.0066943799901413165, 0.9996


def mercator_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it by name."""
    return F.transform(F.array(value), body)[0]


def utm_to_wgs84(x: Column, y: Column, zone: Column, north: Column) -> Column:
    """``struct<lon, lat>`` of UTM metres, by the series of the inverse transverse Mercator projection; each step is computed once."""
    e4, e6, ep = E2**2, E2**3, E2 / (1 - E2)
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    arc = A * (1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256)
    latitude = lambda mu: mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu)

    def parts(p: Column) -> Column:
        c, w = F.cos(p), 1 - E2 * F.sin(p) * F.sin(p)
        n, r = A / F.sqrt(w), A * (1 - E2) / F.pow(w, F.lit(1.5))
        return F.struct(p.alias("p"), c.alias("c"), F.pow(F.tan(p), F.lit(2.0)).alias("t"), (ep * c * c).alias("g"), ((x - 5e5) / (n * K0)).alias("d"), (n * F.tan(p) / r).alias("k"))

    def place(s: Column) -> Column:
        t, g, d = s["t"], s["g"], s["d"]
        lat = s["p"] - s["k"] * (d * d / 2 - (5 + 3 * t + 10 * g - 4 * g * g - 9 * ep) * F.pow(d, F.lit(4.0)) / 24)
        lon = (d - (1 + 2 * t + g) * F.pow(d, F.lit(3.0)) / 6 + (5 - 2 * g + 28 * t - 3 * g * g + 8 * ep + 24 * t * t) * F.pow(d, F.lit(5.0)) / 120) / s["c"]
        return F.struct((F.degrees(lon) + zone * 6 - 183).alias("lon"), F.degrees(lat).alias("lat"))

    mu = F.when(north, y).otherwise(y - 1e7) / K0 / arc
    return _let(mu, lambda m: _let(latitude(m), lambda p: _let(parts(p), place)))


def to_wgs84(epsg: Column, x: Column, y: Column) -> Column:
    """``struct<lon, lat>`` from EPSG:4326, 3857, 326xx and 327xx; null for others."""
    zone = epsg % 100
    utm = F.floor(epsg / 100).isin(326, 327) & zone.between(1, 60)
    mx, my = mercator_to_wgs84(x, y)
    in_zone = utm_to_wgs84(x, y, zone, F.floor(epsg / 100) == 326)
    return F.when(epsg == 4326, F.struct(x.alias("lon"), y.alias("lat"))).when(epsg == 3857, F.struct(mx.alias("lon"), my.alias("lat"))).when(utm, in_zone)


def bounds_to_wgs84(epsg: Column, left: Column, bottom: Column, right: Column, top: Column, steps: int = 16) -> Column:
    """The WGS84 box around bounds whose sides are taken at ``steps`` points."""
    share = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / float(steps))
    sides = [
        F.transform(share, lambda s: to_wgs84(epsg, left + (right - left) * s, bottom)), F.transform(share, lambda s: to_wgs84(epsg, left + (right - left) * s, top)),
        F.transform(share, lambda s: to_wgs84(epsg, left, bottom + (top - bottom) * s)), F.transform(share, lambda s: to_wgs84(epsg, right, bottom + (top - bottom) * s)),
    ]
    points = F.filter(F.concat(*sides), lambda p: p.isNotNull())
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(lon).alias("min_x"), F.array_min(lat).alias("min_y"), F.array_max(lon).alias("max_x"), F.array_max(lat).alias("max_y")))
