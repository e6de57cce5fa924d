"""Queries of pixel pairs: registration, alignment, normalisation, differences, descriptors and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encoders, pixels, registration
from . import proxies as P
from .registry import register

#: Line items as images of so many rows and columns: means of what falls on a pixel.
SIDE = 24
BANDS = ("blue", "green", "red", "nir")


def _images(spark, sf_dir):
    """(tile_id, row, col, bands, valid): four images by the supplier's remainder."""
    rows = P.table(spark, sf_dir, "lineitem")
    place = [(F.col("l_suppkey") % 4).cast("int").alias("tile_id"), (F.col("l_orderkey") % SIDE).cast("int").alias("row"), ((F.col("l_partkey") * 3 + F.col("l_linenumber")) % SIDE).cast("int").alias("col")]
    values = [F.col("l_quantity").cast("double") / 50, F.col("l_tax").cast("double") * 10, F.col("l_discount").cast("double") * 8, F.col("l_quantity").cast("double") / 60]
    out = rows.select(*place, *[v.alias(b) for v, b in zip(values, BANDS, strict=True)], (F.col("l_linenumber") < 7).cast("double").alias("ok"))
    out = out.groupBy("tile_id", "row", "col").agg(*[F.round(F.avg(b), 9).alias(b) for b in BANDS], F.avg("ok").alias("ok"))
    return out.select("tile_id", "row", "col", *BANDS, (F.col("ok") > 0.6).alias("valid"))


IMAGES = f"""images AS (SELECT CAST(l_suppkey % 4 AS INT) AS tile_id, CAST(l_orderkey % {SIDE} AS INT) AS row, CAST((l_partkey * 3 + l_linenumber) % {SIDE} AS INT) AS col, round(avg(CAST(l_quantity AS DOUBLE) / 50), 9) AS blue,
    round(avg(CAST(l_tax AS DOUBLE) * 10), 9) AS green, round(avg(CAST(l_discount AS DOUBLE) * 8), 9) AS red, round(avg(CAST(l_quantity AS DOUBLE) / 60), 9) AS nir, avg(CASE WHEN l_linenumber < 7 THEN 1.0 ELSE 0.0 END) > 0.6 AS valid
  FROM lineitem GROUP BY 1, 2, 3)"""


def _pairs(spark, sf_dir):
    """Pixels of pairs side by side: two of different images, and one of an image and itself two lines up and three columns to the right."""
    rows = _images(spark, sf_dir).withColumn("brightness", (F.col("red") + F.col("green") + F.col("blue")) / 3)
    side = lambda p, tile: rows.filter(F.col("tile_id") == tile).select("row", "col", F.col("brightness").alias(f"{p}_brightness"), F.col("valid").alias(f"{p}_valid"))
    moved = side("a", 0).withColumns({"row": F.pmod(F.col("row") - 2, F.lit(SIDE)), "col": F.pmod(F.col("col") + 3, F.lit(SIDE))})
    out = None
    for name, before, after in (("0-1", side("b", 0), side("a", 1)), ("2-3", side("b", 2), side("a", 3)), ("moved", side("b", 0), moved)):
        met = before.join(after, ["row", "col"]).select(F.lit(name).alias("pair_id"), "row", "col", "b_brightness", "a_brightness", (F.col("b_valid") & F.col("a_valid")).alias("common"))
        out = met if out is None else out.unionByName(met)
    return out


PAIRS = f"""{IMAGES},
bright AS (SELECT *, (red + green + blue) / 3 AS brightness FROM images),
sides AS (SELECT '0-1' AS pair_id, 'b' AS side, row, col, brightness, valid FROM bright WHERE tile_id = 0 UNION ALL SELECT '0-1', 'a', row, col, brightness, valid FROM bright WHERE tile_id = 1
  UNION ALL SELECT '2-3', 'b', row, col, brightness, valid FROM bright WHERE tile_id = 2 UNION ALL SELECT '2-3', 'a', row, col, brightness, valid FROM bright WHERE tile_id = 3
  UNION ALL SELECT 'moved', 'b', row, col, brightness, valid FROM bright WHERE tile_id = 0 UNION ALL SELECT 'moved', 'a', (row - 2 + {SIDE}) % {SIDE}, (col + 3) % {SIDE}, brightness, valid FROM bright WHERE tile_id = 0),
px AS (SELECT b.pair_id, b.row, b.col, b.brightness AS b, a.brightness AS a, b.valid AND a.valid AS common FROM sides b JOIN sides a ON a.pair_id = b.pair_id AND a.row = b.row AND a.col = b.col AND b.side = 'b' AND a.side = 'a')"""


@register("pair_registration", f"""WITH {PAIRS},
size AS (SELECT pair_id, max(row) + 1 AS h, max(col) + 1 AS w FROM px GROUP BY pair_id),
shift AS (SELECT dy, dx FROM range(-8, 9) y(dy) CROSS JOIN range(-8, 9) x(dx) WHERE dy * dy + dx * dx <= 64),
res AS (SELECT p.pair_id, dy, dx, dy * dy + dx * dx AS l, avg(abs(a.a - p.b)) AS r FROM px p JOIN size s USING (pair_id) CROSS JOIN shift
  JOIN px a ON a.pair_id = p.pair_id AND a.row = (p.row - dy + h) % h AND a.col = (p.col - dx + w) % w WHERE p.common GROUP BY p.pair_id, dy, dx),
best AS (SELECT pair_id, first((dy, dx, r, l) ORDER BY round(r, 12), l, dy, dx) AS s, max(r) FILTER (dy = 0 AND dx = 0) AS r0 FROM res GROUP BY pair_id),
done AS (SELECT *, s[4] > 0 AND s[3] < 0.8 * r0 AS applied FROM best)
SELECT pair_id, CAST(CASE WHEN applied THEN s[1] ELSE 0 END AS INT) AS dy, CAST(CASE WHEN applied THEN s[2] ELSE 0 END AS INT) AS dx, round(r0, 6) AS residual, round(s[3], 6) AS shifted_residual, applied,
  round(CASE WHEN applied THEN greatest(0.7, 1 - 0.03 * sqrt(s[4])) ELSE 1.0 END, 6) AS registration FROM done""")  # fmt: skip
def pair_registration(spark, sf_dir):
    out = registration.best_shifts(_pairs(spark, sf_dir))
    return out.select("pair_id", "dy", "dx", F.round("residual", 6).alias("residual"), F.round("shifted_residual", 6).alias("shifted_residual"), "applied", F.round("registration", 6).alias("registration"))


#: Even images onto a grid half a pixel further, odd ones onto one of pixels half as large again.
GRID = "CASE WHEN tile_id % 2 = 0 THEN 1.0 ELSE 1.5 END"


@register("tile_alignment", f"""WITH {IMAGES},
g AS (SELECT tile_id, {GRID} AS k, CASE WHEN tile_id % 2 = 0 THEN 105.0 ELSE 98.0 END AS x0, CASE WHEN tile_id % 2 = 0 THEN 197.5 ELSE 201.0 END AS y0 FROM (SELECT DISTINCT tile_id FROM images)),
cells AS (SELECT tile_id, r AS row, c AS col, (x0 + k * 10 * (c + 0.5) - 100) / 10 - 0.5 AS u, (y0 - k * 10 * (r + 0.5) - 200) / -10 - 0.5 AS v FROM g CROSS JOIN range(0, 20) a(r) CROSS JOIN range(0, 20) b(c)),
near AS (SELECT tile_id, row, col, CAST(floor(v) AS INT) + di AS i, CAST(floor(u) AS INT) + dj AS j, abs(1 - di - (v - floor(v))) * abs(1 - dj - (u - floor(u))) AS w FROM cells CROSS JOIN range(0, 2) a(di) CROSS JOIN range(0, 2) b(dj)
  WHERE u >= -0.5 AND u < {SIDE} - 0.5 AND v >= -0.5 AND v < {SIDE} - 0.5),
m AS (SELECT n.tile_id, n.row, n.col, sum(p.blue * w) / sum(w) AS blue, sum(p.nir * w) / sum(w) AS nir FROM near n JOIN images p ON p.valid AND p.tile_id = n.tile_id AND p.row = n.i AND p.col = n.j WHERE w > 0 GROUP BY ALL)
SELECT tile_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(coalesce(blue, 0), 6) AS blue, round(coalesce(nir, 0), 6) AS nir, blue IS NOT NULL AS valid FROM cells LEFT JOIN m USING (tile_id, row, col)""")  # fmt: skip
def tile_alignment(spark, sf_dir):
    rows = _images(spark, sf_dir)
    lit, even = (lambda v: F.lit(float(v))), F.col("tile_id") % 2 == 0
    either = lambda a, b: F.when(even, lit(a)).otherwise(lit(b))
    affine = lambda a, c, e, f: F.struct(a.alias("a"), lit(0).alias("b"), c.alias("c"), lit(0).alias("d"), e.alias("e"), f.alias("f"))
    side = {"source_height": F.lit(SIDE), "source_width": F.lit(SIDE), "height": F.lit(20), "width": F.lit(20)}
    grids = rows.select("tile_id").distinct().withColumns({"source": affine(lit(10), lit(100), lit(-10), lit(200)), "target": affine(either(10, 15), either(105, 98), either(-10, -15), either(197.5, 201)), **side})
    out = registration.aligned(rows, grids)
    return out.select("tile_id", "row", "col", F.round("blue", 6).alias("blue"), F.round("nir", 6).alias("nir"), "valid")


def _both(spark, sf_dir):
    """Pixels of two pairs of images side by side, with indices, gradients and what is clear."""
    rows = _images(spark, sf_dir)
    pairs = spark.createDataFrame([("0-1", 0, 1), ("2-3", 2, 3)], "pair_id string, before_tile_id int, after_tile_id int")
    return pixels.pair_pixels(F.broadcast(pairs), rows)


#: Indices and classes as the SQL of the images has them; a pixel is clear if no class but haze holds.
CLEAR = f"""{IMAGES},
idx AS (SELECT *, (nir - red) / (nir + red + 1e-6) AS ndvi, (green - nir) / (green + nir + 1e-6) AS ndwi, (red + green + blue) / 3 AS bright, greatest(red, green, blue) AS peak FROM images),
wht AS (SELECT *, sqrt((pow(red - bright, 2) + pow(green - bright, 2) + pow(blue - bright, 2)) / 3) / (bright + 1e-6) AS white FROM idx),
sn AS (SELECT *, valid AND bright > 0.45 AND ndwi > 0.2 AND blue >= red AND nir < bright AS snow FROM wht),
cl AS (SELECT *, valid AND NOT snow AND bright > 0.75 * 0.6 AND white < 0.12 AND (bright > 0.75 OR nir > 0.5) AS cloud FROM sn),
px AS (SELECT *, valid AND NOT cloud AND NOT snow AND blue > 0.2 AND blue > 1.25 * red AND white < 0.25 AS haze, valid AND NOT cloud AND bright < 0.08 AND ndwi < 0.1 AND nir < 0.12 AS shadow, valid AND peak >= 0.999 AS saturated FROM cl),
clear AS (SELECT *, valid AND NOT (saturated OR cloud OR snow OR shadow) AS ok, valid AND NOT (saturated OR cloud OR snow OR shadow OR haze) AS plain FROM px),
met AS (SELECT b.tile_id || '-' || a.tile_id AS pair_id, b.row, b.col, b.ok AND a.ok AS common, b.blue AS b_blue, b.green AS b_green, b.red AS b_red, b.nir AS b_nir, b.ndvi AS b_ndvi, b.ndwi AS b_ndwi, b.bright AS b_bright,
    a.blue AS a_blue, a.green AS a_green, a.red AS a_red, a.nir AS a_nir, a.bright AS a_bright, (abs(a.blue - b.blue) + abs(a.green - b.green) + abs(a.red - b.red) + abs(a.nir - b.nir)) / 4 AS diff
  FROM clear b JOIN clear a ON a.row = b.row AND a.col = b.col AND (b.tile_id, a.tile_id) IN ((0, 1), (2, 3)))"""
_FITS = ", ".join(f"avg(a_{b}) FILTER (still) AS ma_{b}, avg(b_{b}) FILTER (still) AS mb_{b}, stddev_pop(a_{b}) FILTER (still) AS sa_{b}, stddev_pop(b_{b}) FILTER (still) AS sb_{b}" for b in BANDS)
_NORMAL = ", ".join(f"CASE WHEN n < 32 THEN a_{b} ELSE least(greatest((a_{b} - ma_{b}) * least(greatest(sb_{b} / greatest(sa_{b}, 1e-4), 0.5), 2.0) + mb_{b}, 0.0), 1.0) END AS n_{b}" for b in BANDS)
NORMALISED = f"""{CLEAR},
half AS (SELECT pair_id, quantile_cont(diff, 0.5) FILTER (common) AS h, count(*) FILTER (common) AS n FROM met GROUP BY pair_id),
marked AS (SELECT met.*, n, common AND diff <= h AS still FROM met JOIN half USING (pair_id)),
fit AS (SELECT pair_id, {_FITS} FROM marked GROUP BY pair_id),
nm AS (SELECT marked.*, {_NORMAL} FROM marked JOIN fit USING (pair_id))"""


@register("pair_normalised", f"WITH {NORMALISED} SELECT pair_id, row, col, common, {', '.join(f'round(n_{b}, 6) AS {b}' for b in BANDS)} FROM nm")
def pair_normalised(spark, sf_dir):
    """The after image with the before image's radiometry, by the least-changed half of the common pixels."""
    out = pixels.normalised_after(_both(spark, sf_dir))
    return out.select("pair_id", "row", "col", "common", *[F.round(f"n_{b}", 6).alias(b) for b in BANDS])


def _slope(value: str, group: str, along: str, by: str = "pair_id") -> str:
    line = f"OVER (PARTITION BY {by}, {group} ORDER BY {along})"
    before, after = f"lag({value}) {line}", f"lead({value}) {line}"
    return f"CASE WHEN {before} IS NULL AND {after} IS NULL THEN 0.0 WHEN {before} IS NULL THEN {after} - {value} WHEN {after} IS NULL THEN {value} - {before} ELSE ({after} - {before}) / 2 END"


def _ends(group: str, along: str) -> str:
    """A pixel's neighbours on a line, around its ends."""
    line, whole = f"OVER (PARTITION BY pair_id, {group} ORDER BY {along})", f"OVER (PARTITION BY pair_id, {group} ORDER BY {along} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"coalesce(lag(hot) {line}, last_value(hot) {whole}) + coalesce(lead(hot) {line}, first_value(hot) {whole})"


CHANGED = f"""{NORMALISED},
ix AS (SELECT *, (n_nir - n_red) / (n_nir + n_red + 1e-6) AS n_ndvi, (n_green - n_nir) / (n_green + n_nir + 1e-6) AS n_ndwi, (n_red + n_green + n_blue) / 3 AS n_bright FROM nm),
gr AS (SELECT ix.*, sqrt(pow({_slope("n_bright", "row", "col")}, 2) + pow({_slope("n_bright", "col", "row")}, 2)) AS n_grad FROM ix),
bg AS (SELECT tile_id, row, col, sqrt(pow({_slope("bright", "row", "col", "tile_id")}, 2) + pow({_slope("bright", "col", "row", "tile_id")}, 2)) AS b_grad FROM idx),
dl AS (SELECT gr.*, n_ndvi - b_ndvi AS dv, n_ndwi - b_ndwi AS dw, n_bright - b_bright AS db, n_grad - b_grad AS dg,
    sqrt((pow(n_blue - b_blue, 2) + pow(n_green - b_green, 2) + pow(n_red - b_red, 2) + pow(n_nir - b_nir, 2)) / 4) AS rms FROM gr JOIN bg ON bg.tile_id = CAST(left(pair_id, 1) AS INT) AND bg.row = gr.row AND bg.col = gr.col),
mg AS (SELECT *, greatest(abs(dv) / 0.5, abs(dw) / 0.5, abs(db) / 0.25, rms / 0.2) AS mag FROM dl),
ht AS (SELECT *, CASE WHEN common AND mag > 1 THEN 1 ELSE 0 END AS hot FROM mg),
nr AS (SELECT *, hot = 1 AND hot + {_ends("row", "col")} + {_ends("col", "row")} >= 3 AS changed FROM ht),
stats AS (SELECT pair_id, count(*) AS n_pixels, count(*) FILTER (common) AS n_common, count(*) FILTER (changed) AS n_changed, least(greatest(coalesce(avg(mag) FILTER (changed), 0.0) / 3, 0.0), 1.0) AS strength,
    coalesce(avg(dv) FILTER (changed), 0.0) AS d_ndvi, coalesce(avg(dw) FILTER (changed), 0.0) AS d_ndwi, coalesce(avg(db) FILTER (changed), 0.0) AS d_brightness, coalesce(avg(dg) FILTER (changed), 0.0) AS d_edge,
    coalesce(avg(CASE WHEN b_ndwi > 0.1 THEN 1.0 ELSE 0.0 END) FILTER (common), 0.0) AS water_before, coalesce(avg(CASE WHEN n_ndwi > 0.1 THEN 1.0 ELSE 0.0 END) FILTER (common), 0.0) AS water_after,
    coalesce(avg(CASE WHEN b_ndvi < 0.15 AND b_ndwi < 0 AND b_bright > 0.15 THEN 1.0 ELSE 0.0 END) FILTER (common), 0.0) AS built_before, coalesce(avg(CASE WHEN n_ndvi < 0.15 AND n_ndwi < 0 AND n_bright > 0.15 THEN 1.0 ELSE 0.0 END) FILTER (common), 0.0) AS built_after,
    stddev_pop(dv) FILTER (common) AS ndvi_spread, avg(dv) FILTER (common) AS ndvi_shift, quantile_cont(b_bright, 0.5) FILTER (common) AS median_before, quantile_cont(a_bright, 0.5) FILTER (common) AS median_after,
    min(row) FILTER (changed) AS row_min, max(row) FILTER (changed) AS row_max, min(col) FILTER (changed) AS col_min, max(col) FILTER (changed) AS col_max FROM nr GROUP BY pair_id)"""
_ROUNDED = ("strength", "d_ndvi", "d_ndwi", "d_brightness", "d_edge", "water_before", "water_after", "built_before", "built_after", "ndvi_spread", "ndvi_shift", "median_before", "median_after")


@register("pair_changes", f"WITH {CHANGED} SELECT pair_id, n_pixels, n_common, n_changed, row_min, row_max, col_min, col_max, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM stats")
def pair_changes(spark, sf_dir):
    """What changed between two images: share, strength, mean differences and class shares."""
    out = pixels.pair_statistics(pixels.normalised_after(_both(spark, sf_dir)))
    return out.select("pair_id", "n_pixels", "n_common", "n_changed", "row_min", "row_max", "col_min", "col_max", *[F.round(c, 6).alias(c) for c in _ROUNDED])


@register("pair_factors", f"""WITH {CHANGED},
f AS (SELECT *, n_changed / greatest(n_common, 1) AS share, n_common >= 64 AS covered FROM stats)
SELECT pair_id, round(CASE WHEN covered AND share > 0.002 THEN least(greatest(sqrt(share / 0.25) * (0.6 + 0.4 * strength), 0.0), 1.0) ELSE 0.0 END, 6) AS raw_score,
  round(least(greatest(1 - 1.5 * greatest(abs(median_before - median_after) - 0.05, 0), 0.6), 1.0), 6) AS illumination_factor, round(CASE WHEN pair_id = '0-1' THEN 1.0 ELSE 0.85 END, 6) AS sensor_factor,
  round(CASE WHEN covered THEN least(greatest(n_common / n_pixels / 0.5, 0.3), 1.0) ELSE 0.0 END, 6) AS coverage_factor,
  round(CASE WHEN pair_id = '0-1' THEN least(greatest(1 - (20 - 5) / 40.0, 0.6), 1.0) * least(greatest(1 - (30 - 10) / 60.0, 0.7), 1.0) ELSE 1.0 END, 6) AS viewing_geometry_factor FROM f""")  # fmt: skip
def pair_factors(spark, sf_dir):
    """The factors that lower a pair's score; the first pair is of one sensor and seen from different angles, the second of two sensors."""
    first = F.col("pair_id") == "0-1"
    stats = pixels.pair_statistics(pixels.normalised_after(_both(spark, sf_dir)))
    stats = stats.withColumns({"before_sensor": F.lit("MSI"), "after_sensor": F.when(first, F.lit("MSI")).otherwise(F.lit("OLI")), "before_off_nadir": F.when(first, F.lit(0.0)), "after_off_nadir": F.lit(20.0), "before_sun": F.when(first, F.lit(30.0)), "after_sun": F.lit(60.0)})
    out = pixels.scored_pairs(stats)
    return out.select("pair_id", *[F.round(c, 6).alias(c) for c in ("raw_score", "illumination_factor", "sensor_factor", "coverage_factor", "viewing_geometry_factor")])


@register("pair_simple_difference", f"WITH {CLEAR}, s AS (SELECT pair_id, count(*) FILTER (common AND abs(a_bright - b_bright) > 0.1) / greatest(count(*) FILTER (common), 1) AS f FROM met GROUP BY pair_id) SELECT pair_id, round(f, 6) AS changed_fraction, round(least(1.0, 2 * f), 6) AS score FROM s")
def pair_simple_difference(spark, sf_dir):
    out = pixels.simple_difference(_both(spark, sf_dir))
    return out.select("pair_id", F.round("changed_fraction", 6).alias("changed_fraction"), F.round("score", 6).alias("score"))


@register("tile_thumbnails", f"""WITH {IMAGES},
lit AS (SELECT tile_id, unnest([red, green, blue]) AS v FROM images WHERE greatest(red, green, blue) > 0),
ends AS (SELECT tile_id, quantile_cont(v, 0.02) AS low, quantile_cont(v, 0.98) AS high FROM lit GROUP BY tile_id),
cells AS (SELECT tile_id, col // 2 AS x, row // 2 AS y, avg(red) AS r, avg(green) AS g, avg(blue) AS b FROM images GROUP BY ALL)
SELECT tile_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, {', '.join(f'CAST(floor(least(greatest(({c} - low) / greatest(high - low, 1e-6), 0.0), 1.0) * 255) AS INT) AS {c}' for c in 'rgb')} FROM cells JOIN ends USING (tile_id)""")
def tile_thumbnails(spark, sf_dir):
    return pixels.thumbnails(_images(spark, sf_dir), size=12, tile_size=24)


#: Over plain pixels (valid ones if there are fewer than 16): the descriptor's values, straight from the images.
DESCRIBED = f"""{CLEAR},
slope AS (SELECT tile_id, row, col, {_slope("bright", "row", "col", "tile_id")} AS gx, {_slope("bright", "col", "row", "tile_id")} AS gy FROM idx),
many AS (SELECT tile_id, count(*) FILTER (plain) >= 16 AS enough FROM clear GROUP BY tile_id),
used AS (SELECT c.*, gx, gy, sqrt(gx * gx + gy * gy) AS grad FROM clear c JOIN slope USING (tile_id, row, col) JOIN many USING (tile_id) WHERE CASE WHEN enough THEN plain ELSE valid END),
st AS (SELECT tile_id, avg(bright) AS brightness, stddev_pop(bright) AS contrast, avg(CASE WHEN grad > 0.04 THEN 1.0 ELSE 0.0 END) AS edge_density, avg(ndvi) AS ndvi, avg(ndwi) AS ndwi, avg(CASE WHEN ndvi > 0.3 THEN 1.0 ELSE 0.0 END) AS veg_frac,
    avg(CASE WHEN ndwi > 0.1 THEN 1.0 ELSE 0.0 END) AS water_frac, avg(CASE WHEN bright > 0.4 THEN 1.0 ELSE 0.0 END) AS bright_frac, avg(CASE WHEN bright < 0.06 THEN 1.0 ELSE 0.0 END) AS dark_frac, avg(red) AS red, avg(green) AS green, avg(blue) AS blue, avg(nir) AS nir,
    avg(CASE WHEN ndvi < 0.15 AND ndwi < 0 AND bright > 0.15 THEN 1.0 ELSE 0.0 END) AS built_frac, quantile_cont(grad, 0.8) AS p80 FROM used GROUP BY tile_id),
ln AS (SELECT tile_id, CASE WHEN count(*) >= 16 THEN sqrt(pow(sum(gx * gx) - sum(gy * gy), 2) + 4 * pow(sum(gx * gy), 2)) / (sum(gx * gx) + sum(gy * gy) + 1e-6) ELSE 0.0 END AS linearity FROM used JOIN st USING (tile_id) WHERE grad > p80 GROUP BY tile_id),
hist AS (SELECT tile_id, least(floor(bright * 32), 31) AS bin, count(*) AS c FROM used WHERE bright BETWEEN 0 AND 1 GROUP BY 1, 2),
tx AS (SELECT tile_id, -sum(p * log2(p)) / 5 AS texture FROM (SELECT tile_id, c / sum(c) OVER (PARTITION BY tile_id) AS p FROM hist) GROUP BY tile_id),
ds AS (SELECT tile_id, [{', '.join(f"coalesce({c}, 0.0)" for c in pixels.DESCRIPTOR)}] AS d FROM st LEFT JOIN ln USING (tile_id) LEFT JOIN tx USING (tile_id))"""


def _described(spark, sf_dir):
    return pixels.descriptors(pixels.with_classes(pixels.with_indices(_images(spark, sf_dir))))


@register("tile_descriptors", f"WITH {DESCRIBED} SELECT tile_id, i AS place, round(d[i + 1], 6) AS value FROM ds CROSS JOIN range(0, {len(pixels.DESCRIPTOR)}) r(i)")
def tile_descriptors(spark, sf_dir):
    rows = _described(spark, sf_dir).select("tile_id", F.posexplode("descriptor").alias("place", "value"))
    return rows.select("tile_id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


_CENTRED = "[" + ", ".join(f"(d[{i + 1}] - {c}) / {s}" for i, (c, s) in enumerate(zip(pixels.CENTRE, pixels.SCALE, strict=True))) + "]"


@register("tile_vectors", f"""WITH {DESCRIBED},
m(j, w) AS (VALUES {', '.join(f'({j}, CAST({[float(v) for v in column]!r} AS DOUBLE[]))' for j, column in enumerate(encoders.projection(32).T))}),
v AS (SELECT tile_id, j, list_dot_product({_CENTRED}, w) AS x FROM ds CROSS JOIN m)
SELECT tile_id, CAST(j AS BIGINT) AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY tile_id)), 5) AS value FROM v""")
def tile_vectors(spark, sf_dir):
    """Descriptors through the fixed projection, as unit vectors."""
    rows = encoders.encode_descriptors(_described(spark, sf_dir), 32).select("tile_id", F.posexplode("vector").alias("place", "value"))
    return rows.select("tile_id", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 5).alias("value"))
