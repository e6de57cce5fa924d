"""Tile quality and pairwise change from pixel rows.

Pixels are rows (``tile_id, row, col, blue, green, red, nir, valid``), reflectances in 0..1. Per-pixel tests are Column
expressions, tiles are aggregations, and a pixel meets its neighbours by windows over
(tile, row) and (tile, col), never through a whole tile in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, Settings
from ..functions.times import day_gap
from ..functions.vectors import clip

EPS = 1e-6
#: Fixed: codes of the pixel classes, and the order in which later classes win.
CLASSES = {"clear": 0, "nodata": 1, "cloud": 2, "shadow": 3, "snow": 4, "haze": 5, "saturated": 6}
#: Fixed: the names of a descriptor's values in order, and an archive's typical centre and scale of each.
DESCRIPTOR = ["brightness", "contrast", "edge_density", "ndvi", "ndwi", "veg_frac", "water_frac", "bright_frac", "dark_frac", "texture", "linearity", "red", "green", "blue", "nir", "built_frac"]
CENTRE = [0.18, 0.08, 0.12, 0.25, -0.2, 0.35, 0.05, 0.05, 0.08, 0.5, 0.2, 0.12, 0.12, 0.1, 0.3, 0.1]
SCALE = [0.12, 0.06, 0.1, 0.3, 0.3, 0.35, 0.15, 0.12, 0.15, 0.25, 0.2, 0.1, 0.1, 0.1, 0.15, 0.15]


def reflectance(value: Column, dtype: str, sample_max: Column) -> Column:
    """A stored value as reflectance in 0..1, by the storage type and the largest sampled value."""
    if dtype == "uint8":
        scale = F.lit(255.0)
    elif dtype in ("uint16", "int16", "uint32", "int32"):
        scale = F.when(sample_max > 255, F.lit(10000.0)).otherwise(F.lit(255.0))
    else:
        scale = F.when(sample_max <= 1.5, F.lit(1.0)).otherwise(sample_max.cast("double"))
    return clip(value / scale)


def valid_pixel(bands: list[Column], nodata: float | None = None) -> Column:
    """Not all bands at the fill value (0 without one), and none missing."""
    filled = F.forall(F.array(*bands), lambda b: b == (0.0 if nodata is None or math.isnan(nodata) else nodata))
    broken = F.exists(F.array(*bands), lambda b: b.isNull() | F.isnan(b.cast("double")))
    return ~F.coalesce(filled, F.lit(True)) & ~broken


def band_roles(bands: list[str]) -> dict[str, Column]:
    """Columns for blue, green, red and nir; missing ones are taken from what is there."""
    at = lambda k: F.col(bands[min(k, len(bands) - 1)])
    nir = F.col(bands[1]) if len(bands) == 3 else at(3)
    return {"blue": at(0), "green": at(1), "red": at(2), "nir": nir}


def with_indices(pixels: DataFrame) -> DataFrame:
    r, g, b, n = (F.col(c) for c in ("red", "green", "blue", "nir"))
    bright = (r + g + b) / 3
    spread = F.sqrt((F.pow(r - bright, F.lit(2.0)) + F.pow(g - bright, F.lit(2.0)) + F.pow(b - bright, F.lit(2.0))) / 3)
    return pixels.withColumns({"ndvi": (n - r) / (n + r + EPS), "ndwi": (g - n) / (g + n + EPS), "brightness": bright, "whiteness": spread / (bright + EPS), "peak": F.greatest(r, g, b)})


def with_classes(pixels: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds the tests ``is_snow`` and so on, and ``class``."""
    c, s = settings.cloud_bright, settings.shadow_dark
    bright, white, ndwi, blue, red, nir = (F.col(x) for x in ("brightness", "whiteness", "ndwi", "blue", "red", "nir"))
    out = pixels.withColumn("is_snow", F.col("valid") & (bright > 0.45) & (ndwi > 0.2) & (blue >= red) & (nir < bright))
    out = out.withColumn("is_cloud", F.col("valid") & ~F.col("is_snow") & (bright > c * 0.6) & (white < 0.12) & ((bright > c) | (nir > 0.5)))
    out = out.withColumns({
        "is_haze": F.col("valid") & ~F.col("is_cloud") & ~F.col("is_snow") & (blue > 0.2) & (blue > 1.25 * red) & (white < 0.25),
        "is_shadow": F.col("valid") & ~F.col("is_cloud") & (bright < s) & (ndwi < 0.1) & (nir < 0.12),
        "is_saturated": F.col("valid") & (F.col("peak") >= 0.999),
    })
    code = F.when(~F.col("valid"), F.lit(CLASSES["nodata"]))
    for name in ("saturated", "cloud", "snow", "shadow", "haze"):
        code = code.when(F.col(f"is_{name}"), F.lit(CLASSES[name]))
    return out.withColumn("class", code.otherwise(F.lit(CLASSES["clear"])))


def tile_quality(classified: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row a tile: shares, radiometry, overall quality, and whether it serves change detection."""
    valid = F.col("valid")
    share = lambda name: F.count_if(F.col(f"is_{name}"))
    sums = classified.groupBy("tile_id").agg(
        F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), *[share(k).alias(k) for k in ("cloud", "haze", "snow", "shadow", "saturated")],
        F.count_if(F.col("class") == CLASSES["clear"]).alias("clear"), F.percentile(F.when(valid, F.col("brightness")), F.lit(0.98)).alias("p98"), F.percentile(F.when(valid, F.col("brightness")), F.lit(0.02)).alias("p02"),
    )
    of_valid = lambda k: F.coalesce(F.col(k) / F.nullif(F.col("n_valid"), F.lit(0)), F.lit(0.0))
    out = sums.select(
        "tile_id", F.least(F.lit(1.0), of_valid("cloud") * 1.15).alias("cloud_score"), of_valid("haze").alias("haze_score"), of_valid("snow").alias("snow_score"), of_valid("shadow").alias("shadow_score"),
        (F.col("n_valid") / F.col("n")).alias("valid_pixel_ratio"), (F.col("clear") / F.col("n")).alias("clear_ratio"),
        F.when(F.col("n_valid") > 0, clip(1 - 2 * of_valid("saturated")) * clip((F.col("p98") - F.col("p02")) / 0.01, 0.5, 1.0)).otherwise(F.lit(0.0)).alias("radiometric_quality"),
    )
    return with_overall(out, settings)


def with_overall(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    product = F.col("valid_pixel_ratio") * (1 - F.col("cloud_score")) * (1 - 0.6 * F.col("haze_score")) * (1 - 0.5 * F.col("snow_score")) * (1 - 0.5 * F.col("shadow_score")) * F.col("radiometric_quality")
    out = rows.withColumn("overall_quality", clip(product))
    usable = (F.col("overall_quality") >= settings.min_change_quality) & (F.col("valid_pixel_ratio") >= settings.min_valid_ratio) & (F.col("clear_ratio") >= settings.min_valid_ratio)
    return out.withColumn("usable_for_change_detection", usable)


def _slope(value: str, group: str, along: str) -> Column:
    """Central differences inside, one-sided at the ends."""
    line = Window.partitionBy("tile_id", group).orderBy(along)
    before, after = F.lag(value).over(line), F.lead(value).over(line)
    return F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)


def with_gradient(pixels: DataFrame, value: str = "brightness") -> DataFrame:
    out = pixels.withColumns({"gx": _slope(value, "row", "col"), "gy": _slope(value, "col", "row")})
    return out.withColumn("gradient", F.hypot("gx", "gy"))


def linearity(gradients: DataFrame, where: Column) -> DataFrame:
    """(tile_id, linearity): how far strong gradients (over the 80th percentile; at least 16) share one direction."""
    rows = gradients.filter(where)
    strong = rows.join(rows.groupBy("tile_id").agg(F.percentile("gradient", F.lit(0.8)).alias("p80")), "tile_id").filter("gradient > p80")
    xx, yy, xy = F.sum(F.col("gx") * F.col("gx")), F.sum(F.col("gy") * F.col("gy")), F.sum(F.col("gx") * F.col("gy"))
    value = F.sqrt(F.pow(xx - yy, F.lit(2.0)) + 4 * xy * xy) / (xx + yy + EPS)
    return strong.groupBy("tile_id").agg(F.when(F.count("*") >= 16, value).otherwise(F.lit(0.0)).alias("linearity"))


def entropy(pixels: DataFrame, where: Column, bins: int = 32, value: str = "brightness") -> DataFrame:
    """(tile_id, texture): the entropy of a histogram over 0..1, as a share of its largest."""
    inside = where & F.col(value).between(0, 1)
    counts = pixels.filter(inside).groupBy("tile_id", F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy("tile_id"))
    return counts.withColumn("p", F.col("c") / total).groupBy("tile_id").agg((-F.sum(F.col("p") * F.log2("p")) / math.log2(bins)).alias("texture"))


def descriptors(classified: DataFrame) -> DataFrame:
    """(tile_id, descriptor): the values of DESCRIPTOR over clear pixels (all valid ones if there are fewer than 16; the centre without any)."""
    rows = with_gradient(classified)
    clear = F.col("valid") & (F.col("class") == CLASSES["clear"])
    enough = F.count_if(clear).over(Window.partitionBy("tile_id")) >= 16
    rows = rows.withColumn("used", F.when(enough, clear).otherwise(F.col("valid")))
    used = rows.filter("used")
    share = lambda c: F.avg(c.cast("double"))
    built = (F.col("ndvi") < 0.15) & (F.col("ndwi") < 0) & (F.col("brightness") > 0.15)
    stats = used.groupBy("tile_id").agg(
        F.avg("brightness").alias("brightness"), F.stddev_pop("brightness").alias("contrast"), share(F.col("gradient") > 0.04).alias("edge_density"), F.avg("ndvi").alias("ndvi"), F.avg("ndwi").alias("ndwi"),
        share(F.col("ndvi") > 0.3).alias("veg_frac"), share(F.col("ndwi") > 0.1).alias("water_frac"), share(F.col("brightness") > 0.4).alias("bright_frac"), share(F.col("brightness") < 0.06).alias("dark_frac"),
        *[F.avg(c).alias(c) for c in ("red", "green", "blue", "nir")], share(built).alias("built_frac"),
    )
    out = rows.select("tile_id").distinct().join(stats, "tile_id", "left").join(linearity(rows, F.col("used")), "tile_id", "left").join(entropy(rows, F.col("used")), "tile_id", "left")
    values = [F.when(F.col("brightness").isNull(), F.lit(c)).otherwise(F.coalesce(name, F.lit(0.0))) for name, c in zip(DESCRIPTOR, CENTRE, strict=True)]
    return out.select("tile_id", F.array(*values).alias("descriptor"))


def pair_pixels(pairs: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels of both tiles of ``pairs(pair_id, before_tile_id, after_tile_id)``, side by side where both are clear: ``b_*`` and ``a_*``."""
    rows = with_gradient(with_classes(with_indices(pixels)))
    rows = rows.withColumn("is_clear", F.col("valid") & F.col("class").isin(CLASSES["clear"], CLASSES["haze"]))
    names = ["row", "col", "blue", "green", "red", "nir", "ndvi", "ndwi", "brightness", "gradient", "is_clear"]
    side = lambda p, tile: rows.select(F.col("tile_id").alias(tile), *[F.col(c).alias(c if c in ("row", "col") else f"{p}_{c}") for c in names])
    met = pairs.join(side("b", "before_tile_id"), "before_tile_id").join(side("a", "after_tile_id"), ["after_tile_id", "row", "col"])
    return met.withColumn("common", F.col("b_is_clear") & F.col("a_is_clear"))


def normalised_after(pixels: DataFrame, bands: tuple[str, ...] = ("blue", "green", "red", "nir")) -> DataFrame:
    """The after bands with the before image's mean and spread on the least-changed half of the common pixels (gain within 0.5..2)."""
    diff = sum((F.abs(F.col(f"a_{b}") - F.col(f"b_{b}")) for b in bands), F.lit(0.0)) / len(bands)
    rows = pixels.withColumn("_diff", diff)
    half = rows.groupBy("pair_id").agg(F.percentile(F.when(F.col("common"), F.col("_diff")), F.lit(0.5)).alias("_half"), F.count_if("common").alias("_n"))
    still = F.col("common") & (F.col("_diff") <= F.col("_half"))
    fits = []
    for b in bands:
        for p in ("a", "b"):
            fits += [F.avg(F.when(still, F.col(f"{p}_{b}"))).alias(f"_m{p}_{b}"), F.stddev_pop(F.when(still, F.col(f"{p}_{b}"))).alias(f"_s{p}_{b}")]
    fit = rows.join(half, "pair_id").groupBy("pair_id", "_n").agg(*fits)
    out = rows.join(fit, "pair_id")
    for b in bands:
        gain = clip(F.col(f"_sb_{b}") / F.greatest(F.col(f"_sa_{b}"), F.lit(1e-4)), 0.5, 2.0)
        out = out.withColumn(f"n_{b}", F.when(F.col("_n") < 32, F.col(f"a_{b}")).otherwise(clip((F.col(f"a_{b}") - F.col(f"_ma_{b}")) * gain + F.col(f"_mb_{b}"))))
    return out.drop("_diff", *[c for c in out.columns if c.startswith(("_ma", "_mb", "_sa", "_sb"))], "_n")


def pair_statistics(pixels: DataFrame) -> DataFrame:
    """One row a pair: share and strength of the change, mean differences, class shares before and after."""
    r, g, b, n = (F.col(f"n_{c}") for c in ("red", "green", "blue", "nir"))
    out = pixels.withColumns({"n_ndvi": (n - r) / (n + r + EPS), "n_ndwi": (g - n) / (g + n + EPS), "n_brightness": (r + g + b) / 3})
    line = lambda group, along: Window.partitionBy("pair_id", group).orderBy(along)
    slopes = {}
    for name, group, along in (("_gx", "row", "col"), ("_gy", "col", "row")):
        before, after = F.lag("n_brightness").over(line(group, along)), F.lead("n_brightness").over(line(group, along))
        slopes[name] = F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - F.col("n_brightness")).when(after.isNull(), F.col("n_brightness") - before).otherwise((after - before) / 2)
    out = out.withColumns(slopes).withColumn("n_gradient", F.hypot("_gx", "_gy"))
    deltas = {f"d_{c}": F.col(f"n_{c}") - F.col(f"b_{c}") for c in ("ndvi", "ndwi", "brightness", "gradient")}
    rms = F.sqrt(sum((F.pow(F.col(f"n_{c}") - F.col(f"b_{c}"), F.lit(2.0)) for c in ("blue", "green", "red", "nir")), F.lit(0.0)) / 4)
    out = out.withColumns(deltas | {"_rms": rms})
    out = out.withColumn("magnitude", F.greatest(F.abs("d_ndvi") / 0.5, F.abs("d_ndwi") / 0.5, F.abs("d_brightness") / 0.25, F.col("_rms") / 0.2))
    out = out.withColumn("_hot", (F.col("common") & (F.col("magnitude") > 1)).cast("int"))
    near = F.col("_hot")
    for group, along in (("row", "col"), ("col", "row")):
        w = line(group, along)
        edge = Window.partitionBy("pair_id", group).orderBy(along).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        # neighbours wrap around at the tile's edges
        near = near + F.coalesce(F.lag("_hot").over(w), F.last("_hot").over(edge)) + F.coalesce(F.lead("_hot").over(w), F.first("_hot").over(edge))
    out = out.withColumn("_near", near).withColumn("changed", (F.col("_hot") == 1) & (F.col("_near") >= 3))
    common, changed = F.col("common"), F.col("changed")
    mean = lambda c: F.coalesce(F.avg(F.when(changed, F.col(c))), F.lit(0.0))
    share = lambda c: F.coalesce(F.avg(F.when(common, c.cast("double"))), F.lit(0.0))
    built = lambda p: (F.col(f"{p}_ndvi") < 0.15) & (F.col(f"{p}_ndwi") < 0) & (F.col(f"{p}_brightness") > 0.15)
    return out.groupBy("pair_id").agg(
        F.count("*").alias("n_pixels"), F.count_if(common).alias("n_common"), F.count_if(changed).alias("n_changed"), clip(mean("magnitude") / 3).alias("strength"),
        mean("d_ndvi").alias("d_ndvi"), mean("d_ndwi").alias("d_ndwi"), mean("d_brightness").alias("d_brightness"), mean("d_gradient").alias("d_edge"),
        share(F.col("b_ndwi") > 0.1).alias("water_before"), share(F.col("n_ndwi") > 0.1).alias("water_after"), share(built("b")).alias("built_before"), share(built("n")).alias("built_after"),
        share(F.col("b_ndvi") > 0.3).alias("veg_before"), F.stddev_pop(F.when(common, F.col("d_ndvi"))).alias("ndvi_spread"), F.avg(F.when(common, F.col("d_ndvi"))).alias("ndvi_shift"),
        F.percentile(F.when(common, F.col("b_brightness")), F.lit(0.5)).alias("median_before"), F.percentile(F.when(common, F.col("a_brightness")), F.lit(0.5)).alias("median_after"),
        F.min(F.when(changed, F.col("row"))).alias("row_min"), F.max(F.when(changed, F.col("row"))).alias("row_max"), F.min(F.when(changed, F.col("col"))).alias("col_min"), F.max(F.when(changed, F.col("col"))).alias("col_max"),
    )


def scored_pairs(stats: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds ``raw_score, change_type, factors, score`` to pair statistics (optional columns ``line_before, line_after, registration,
    before_time, after_time, before_sensor, after_sensor, before_off_nadir, after_off_nadir, before_sun, after_sun``)."""
    has = set(stats.columns)
    get = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in has else F.lit(default)
    known = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() if {a, b} <= has else F.lit(False)
    plus = lambda x: F.greatest(x, F.lit(0.0))
    covered = F.col("n_common") >= 64
    share = F.col("n_changed") / F.greatest(F.col("n_common"), F.lit(1))
    raw = F.when(covered & (share > 0.002), clip(F.sqrt(share / 0.25) * (0.6 + 0.4 * F.col("strength")))).otherwise(F.lit(0.0))
    dv, dw, db, de = (F.col(c) for c in ("d_ndvi", "d_ndwi", "d_brightness", "d_edge"))
    water, built = F.col("water_after") - F.col("water_before"), F.col("built_after") - F.col("built_before")
    line = get("line_after", 0.0) - get("line_before", 0.0)
    # Fixed: the change types with their weights, in the order in which equals win.
    types = {
        "water_extent_change": 4 * F.abs(water) + 1.5 * F.abs(dw),
        "construction": 1.2 * plus(-dv) + 12 * plus(de) + 4 * plus(built),
        "clearance": 2 * plus(-dv) + plus(db) - 6 * plus(de),
        "road_development": 4 * plus(line) + 1.5 * plus(built),
        "appearance": 2 * plus(db) + 5 * plus(de),
        "disappearance": 2 * plus(-db) + 5 * plus(-de),
        "expansion": 3 * plus(built),
        "contraction": 3 * plus(-built),
    }
    best = F.array_max(F.array(*[F.struct(plus(v).alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, v) in enumerate(types.items())]))
    out = stats.withColumns({"changed_fraction": F.when(covered, share).otherwise(F.lit(0.0)), "raw_score": raw, "_best": best})
    out = out.withColumn("change_type", F.when((F.col("raw_score") > 0) & (F.col("_best.score") >= 0.1), F.col("_best.name")).otherwise(F.lit("unknown")))
    plain = F.col("change_type").isin("clearance", "unknown", "appearance", "disappearance") & (F.col("veg_before") > 0.3)
    uniform = F.col("ndvi_spread") < 0.6 * F.abs("ndvi_shift") + 0.05
    structural = (F.abs(de) > 0.01) | (F.abs(built) > 0.05)
    late = F.coalesce(day_gap(F.col("before_time"), F.col("after_time")) > settings.season_tolerance_days, F.lit(False)) if {"before_time", "after_time"} <= has else F.lit(False)
    gap = F.abs(F.col("median_before") - F.col("median_after"))
    nadir = F.when(known("before_off_nadir", "after_off_nadir"), clip(1 - plus(F.abs(get("before_off_nadir", 0.0) - get("after_off_nadir", 0.0)) - 5) / 40, 0.6, 1.0)).otherwise(F.lit(1.0))
    sun = F.when(known("before_sun", "after_sun"), clip(1 - plus(F.abs(get("before_sun", 0.0) - get("after_sun", 0.0)) - 10) / 60, 0.7, 1.0)).otherwise(F.lit(1.0))
    factors = {
        "registration_factor": get("registration", 1.0),
        "illumination_factor": clip(1 - 1.5 * plus(F.coalesce(gap, F.lit(0.0)) - 0.05), 0.6, 1.0),
        "seasonal_factor": F.when(plain & uniform & ~structural, F.when(late, F.lit(0.35)).otherwise(F.lit(0.6))).otherwise(F.lit(1.0)),
        "sensor_factor": F.when(get("before_sensor", "") == get("after_sensor", ""), F.lit(1.0)).otherwise(F.lit(0.85)),
        "viewing_geometry_factor": nadir * sun,
        "coverage_factor": F.when(covered, clip(F.col("n_common") / F.col("n_pixels") / 0.5, 0.3, 1.0)).otherwise(F.lit(0.0)),
    }
    out = out.withColumns(factors)
    product = F.col("raw_score")
    for name in factors:
        product = product * F.col(name)
    direction = F.when(F.col("change_type") == "water_extent_change", F.when(water > 0, F.lit("expansion")).otherwise(F.lit("contraction")))
    return out.withColumns({"score": clip(product), "water_direction": direction}).drop("_best")


def simple_difference(pixels: DataFrame) -> DataFrame:
    """The plain detector: the share of common pixels whose brightness differs by over 0.1, doubled."""
    hot = F.col("common") & (F.abs(F.col("a_brightness") - F.col("b_brightness")) > 0.1)
    return pixels.groupBy("pair_id").agg((F.count_if(hot) / F.greatest(F.count_if("common"), F.lit(1))).alias("changed_fraction")).withColumn("score", F.least(F.lit(1.0), 2 * F.col("changed_fraction")))


def thumbnails(pixels: DataFrame, size: int = 128, tile_size: int = 256) -> DataFrame:
    """(tile_id, x, y, r, g, b): a preview grid of means, stretched between the 2nd and 98th percentile of lit pixels, in 0..255."""
    step = max(tile_size // size, 1)
    rows = pixels.withColumn("_lit", F.greatest("red", "green", "blue") > 0)
    values = rows.filter("_lit").select("tile_id", F.explode(F.array("red", "green", "blue")).alias("v"))
    ends = values.groupBy("tile_id").agg(F.percentile("v", F.lit(0.02)).alias("low"), F.percentile("v", F.lit(0.98)).alias("high"))
    cells = rows.groupBy("tile_id", F.floor(F.col("col") / step).alias("x"), F.floor(F.col("row") / step).alias("y")).agg(*[F.avg(c).alias(c) for c in ("red", "green", "blue")])
    out = cells.join(ends, "tile_id", "left")
    shade = lambda c: F.floor(F.coalesce(clip((F.col(c) - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-6))), F.col(c)) * 255).cast("int")
    return out.select("tile_id", "x", "y", shade("red").alias("r"), shade("green").alias("g"), shade("blue").alias("b"))
