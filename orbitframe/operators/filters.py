"""Metadata filters over tiles and scenes, as conditions that reach the Parquet scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spatial import overlaps


class InvalidRequest(ValueError):
    """A parameter is out of its range."""


@dataclass
class TileFilter:
    """Bounds are inclusive, and a null never passes one. Long id lists come as DataFrames."""

    bbox: list[float] | None = None
    date_from: object = None
    date_to: object = None
    sensor: str | None = None
    platform: str | None = None
    min_quality: float | None = None
    max_cloud: float | None = None
    scene_ids: list[str] | DataFrame | None = None
    exclude_tile_ids: list[str] | DataFrame | None = field(default=None)

    def is_empty(self) -> bool:
        """Whether nothing narrows the search; a least quality of 0 and exclusions don't count, a greatest cloud share of 0 does."""
        return not (self.bbox or self.date_from or self.date_to or self.sensor or self.platform or self.min_quality or self.max_cloud is not None or self.scene_ids is not None)

    def conditions(self) -> list[Column]:
        out = [overlaps(self.bbox)] if self.bbox else []
        if self.date_from is not None:
            out.append(F.col("acquisition_time") >= F.lit(self.date_from))
        if self.date_to is not None:
            out.append(F.col("acquisition_time") <= F.lit(self.date_to))
        out += [F.lower(F.col(c)) == v.lower() for c, v in (("sensor", self.sensor), ("platform", self.platform)) if v]
        if self.min_quality is not None:
            out.append(F.col("quality_score") >= self.min_quality)
        if self.max_cloud is not None:
            out.append(F.col("cloud_percentage") <= self.max_cloud)
        if isinstance(self.scene_ids, list):
            out.append(F.col("scene_id").isin(self.scene_ids))
        if isinstance(self.exclude_tile_ids, list) and self.exclude_tile_ids:
            out.append(~F.col("tile_id").isin(self.exclude_tile_ids))
        return out

    def apply(self, tiles: DataFrame) -> DataFrame:
        conditions = self.conditions()
        out = tiles.filter(reduce(and_, conditions)) if conditions else tiles
        if isinstance(self.scene_ids, DataFrame):
            out = out.join(self.scene_ids.select("scene_id").distinct(), "scene_id", "left_semi")
        if isinstance(self.exclude_tile_ids, DataFrame):
            out = out.join(self.exclude_tile_ids.select("tile_id"), "tile_id", "left_anti")
        return out


def check_bbox(bbox: list[float], on_earth: bool = True) -> list[float]:
    x0, y0, x1, y1 = bbox if len(bbox) == 4 else (1, 1, 0, 0)
    if x0 > x1 or y0 > y1 or (on_earth and not (-180 <= x0 and x1 <= 180 and -90 <= y0 and y1 <= 90)):
        raise InvalidRequest("bbox must be [min_lon, min_lat, max_lon, max_lat]")
    return [float(v) for v in bbox]


def check_dates(start, end, may_be_equal: bool = True) -> None:
    if start is not None and end is not None and (start > end or (start == end and not may_be_equal)):
        raise InvalidRequest("the start must be before the end")


def check_top_k(top_k: int) -> int:
    if not 1 <= top_k <= 500:
        raise InvalidRequest("top_k must be between 1 and 500")
    return top_k


def scene_list(scenes: DataFrame, where: TileFilter, status: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Scenes that pass, newest first and those without a time last."""
    out = where.apply(scenes)
    out = out.filter(F.col("status") == status) if status else out
    out = out.orderBy(F.desc_nulls_last("acquisition_time"), "scene_id")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def scene_total(scenes: DataFrame, where: TileFilter, status: str | None = None) -> DataFrame:
    """One row: how many scenes all pages of :func:`scene_list` have together."""
    return scene_list(scenes, where, status).agg(F.count("*").alias("total"))


def tiles_of(tiles: DataFrame, scene_id: str) -> DataFrame:
    return tiles.filter(F.col("scene_id") == scene_id).orderBy(F.desc("y_index"), "x_index")


def with_tile_counts(scenes: DataFrame, tiles: DataFrame) -> DataFrame:
    counts = tiles.groupBy("scene_id").agg(F.count("*").alias("tile_count"))
    return scenes.join(counts, "scene_id", "left").withColumn("tile_count", F.coalesce("tile_count", F.lit(0)))
