"""Registration of two tiles by an integer shift, and alignment of a tile to another grid.

Pixels are rows. A shift's residual is a sum over pixels that an offset join brings together; a target cell is a weighted mean of the source
pixels around it, found by an equality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clip

#: Fixed: the largest shift that is looked for, how much smaller the residual must be, and the penalty a pixel of shift.
MOST, BETTER, PENALTY, LEAST_FACTOR = 8, 0.8, 0.03, 0.7


def _lines(pixels: DataFrame, value: Column, name: str) -> DataFrame:
    """(pair_id, row, name): each image line as an array by column, nulls where a pixel is missing."""
    line = pixels.groupBy("pair_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", value.alias("v")))).alias("l"), F.max("width").alias("width"))
    # a line without gaps is its values; else each column looks its value up
    whole = F.transform("l", lambda p: p["v"])
    filled = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.get(F.filter("l", lambda p: p["col"] == c), 0)["v"])
    return line.select("pair_id", "row", F.when(F.size("l") == F.col("width"), whole).otherwise(filled).alias(name))


def _sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("pair_id").agg((F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width"))


def shift_residuals(pixels: DataFrame, most: int = MOST) -> DataFrame:
    """``(pair_id, dy, dx, residual)``: the mean difference of brightness on common pixels with the after image rolled by each shift.

    ``pixels(pair_id, row, col, b_brightness, a_brightness, common)``, one a place, rows and columns from 0. Lines of the after image are copied once a
    row shift and meet the before lines of the place; the column shifts and pixels are then rows of one task, whose sums combine before the shuffle.
    """
    rows = pixels.select("pair_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "b_brightness", "a_brightness", "common")
    rows = rows.join(_sizes(rows), "pair_id")
    after = _lines(rows, F.col("a_brightness"), "after").join(_sizes(rows), "pair_id")
    before = _lines(rows, F.when(F.col("common"), F.col("b_brightness")), "before")
    shifts = F.sequence(F.lit(-most), F.lit(most))
    moved = after.select("pair_id", "after", "width", "height", F.col("row").alias("_row"), F.explode(shifts).alias("dy"))
    moved = moved.select("pair_id", "after", "width", "dy", F.pmod(F.col("_row") + F.col("dy"), F.col("height")).alias("row"))
    met = moved.join(before, ["pair_id", "row"]).select("pair_id", "dy", "width", "after", "before", F.explode(shifts).alias("dx"))
    met = met.select("pair_id", "dy", "dx", "width", "after", F.posexplode("before").alias("c", "b"))
    gap = F.abs(F.get("after", F.pmod(F.col("c") - F.col("dx"), F.col("width"))) - F.col("b"))
    return met.groupBy("pair_id", "dy", "dx").agg(F.avg(gap).alias("residual"))


def best_shifts(pixels: DataFrame, most: int = MOST) -> DataFrame:
    """``(pair_id, dy, dx, residual, shifted_residual, applied, registration)``: the shift that leaves least, and the factor for the pair's score.

    A shift counts only if it leaves less than BETTER of what no shift leaves; without one the shift is 0 and the factor 1. Ties: the shorter, then the smaller shift.
    """
    found = shift_residuals(pixels, most).withColumn("length", F.hypot("dy", "dx")).filter(F.col("residual").isNotNull() & (F.col("length") <= most))
    key = F.struct(F.round("residual", 12).alias("r"), (F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).alias("l"), "dy", "dx", "residual", "length")
    best = found.groupBy("pair_id").agg(F.min(key).alias("best"), F.max(F.when((F.col("dy") == 0) & (F.col("dx") == 0), F.col("residual"))).alias("residual"))
    applied = F.coalesce((F.col("best.length") > 0) & (F.col("best.residual") < BETTER * F.col("residual")), F.lit(False))
    moved = lambda c: F.when(applied, F.col(f"best.{c}")).otherwise(F.lit(0))
    return best.select(
        "pair_id", moved("dy").alias("dy"), moved("dx").alias("dx"), "residual", F.col("best.residual").alias("shifted_residual"), applied.alias("applied"),
        F.when(applied, clip(1 - PENALTY * F.col("best.length"), LEAST_FACTOR, 1.0)).otherwise(F.lit(1.0)).alias("registration"),
    )


def with_shift(pixels: DataFrame, shifts: DataFrame) -> DataFrame:
    """``pixels`` with the after values (``a_*``) of each pair rolled by its shift."""
    names = [c for c in pixels.columns if c.startswith("a_")]
    sized = pixels.join(_sizes(pixels), "pair_id").join(shifts.select("pair_id", "dy", "dx"), "pair_id")
    rolled = sized.select("pair_id", F.pmod(F.col("row") + F.col("dy"), F.col("height")).alias("row"), F.pmod(F.col("col") + F.col("dx"), F.col("width")).alias("col"), *names)
    return pixels.drop(*names).join(rolled, ["pair_id", "row", "col"], "left").select(*pixels.columns)


def aligned(pixels: DataFrame, grids: DataFrame, bands: tuple[str, ...] = ("blue", "green", "red", "nir"), fill: float = 0.0) -> DataFrame:
    """``(tile_id, row, col, *bands, valid)``: each cell of a tile's target grid by bilinear weights of the four source pixels around its centre.

    ``grids(tile_id, source, target, source_height, source_width, height, width)``; ``source`` and ``target`` are affine maps ``struct<a, b, c, d, e, f>`` from
    (column, row) to the shared reference system: x = a col + b row + c, y = d col + e row + f. Missing and invalid pixels give their weight to the
    others. A cell whose centre is outside the source, or that no valid pixel is near to, gets ``fill``.
    """
    cells = grids.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    s, t = (lambda k: F.col(f"source.{k}")), (lambda k: F.col(f"target.{k}"))
    x = t("a") * (F.col("col") + 0.5) + t("b") * (F.col("row") + 0.5) + t("c") - s("c")
    y = t("d") * (F.col("col") + 0.5) + t("e") * (F.col("row") + 0.5) + t("f") - s("f")
    det = s("a") * s("e") - s("b") * s("d")
    cells = cells.withColumns({"u": (s("e") * x - s("b") * y) / det - 0.5, "v": (s("a") * y - s("d") * x) / det - 0.5})
    cells = cells.withColumns({"i": F.floor("v").cast("int"), "j": F.floor("u").cast("int")})
    within = (F.col("u") >= -0.5) & (F.col("u") < F.col("source_width") - 0.5) & (F.col("v") >= -0.5) & (F.col("v") < F.col("source_height") - 0.5)
    down, right = F.col("v") - F.col("i"), F.col("u") - F.col("j")
    near = lambda di, dj: F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), ((down if di else 1 - down) * (right if dj else 1 - right)).alias("w"))
    around = cells.filter(within).select("tile_id", "row", "col", F.explode(F.array(*[near(di, dj) for di in (0, 1) for dj in (0, 1)])).alias("n")).filter("n.w > 0")
    source = pixels.filter("valid").select("tile_id", F.col("row").cast("int").alias("i"), F.col("col").cast("int").alias("j"), *bands)
    met = around.select("tile_id", "row", "col", "n.i", "n.j", "n.w").join(source, ["tile_id", "i", "j"])
    means = met.groupBy("tile_id", "row", "col").agg(*[(F.sum(F.col(b) * F.col("w")) / F.sum("w")).alias(b) for b in bands], F.lit(True).alias("valid"))
    out = cells.select("tile_id", "row", "col").join(means, ["tile_id", "row", "col"], "left")
    return out.select("tile_id", "row", "col", *[F.coalesce(b, F.lit(fill)).alias(b) for b in bands], F.coalesce("valid", F.lit(False)).alias("valid"))
