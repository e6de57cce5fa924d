"""Filtered similarity search with weighted reranking.

One exact plan: filter tiles (pushed to the scan), join embeddings, score, keep the pool with a
total order (a distributed top-k), then score the components of those few rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, Settings
from ..functions import scores as S
from ..functions.spatial import covered_fraction
from ..functions.vectors import clip, dot
from .filters import TileFilter, check_bbox, check_dates, check_top_k


@dataclass
class SearchParams:
    top_k: int = 20
    where: TileFilter = field(default_factory=TileFilter)
    group_by_location: bool = True
    temporal_intent: bool = False
    context: list[str] = field(default_factory=list)
    change_types: list[str] = field(default_factory=list)
    #: Name and version of the model whose vectors are searched; None: the table holds one model's only.
    model: tuple[str, str] | None = None


def similar(tiles: DataFrame, embeddings: DataFrame, query: Column, k: int, where: TileFilter, model: tuple[str, str] | None = None) -> DataFrame:
    """The ``k`` tiles that pass the filter and are most similar by the model's vectors: tile columns and ``sim``. Ties go by vector id.

    Of vectors with a ``type`` only those of images count.
    """
    if model is not None:
        embeddings = embeddings.filter((F.col("model_name") == model[0]) & (F.col("model_version") == model[1]))
    if "type" in embeddings.columns:
        embeddings = embeddings.filter(F.col("type") == "image")
    vectors = embeddings.select("tile_id", "vector_id", "vector")
    scored = where.apply(tiles).join(vectors, "tile_id").withColumn("sim", dot(F.col("vector"), query)).drop("vector")
    return scored.orderBy(F.desc("sim"), "vector_id").limit(k)


def temporal_scores(candidates: DataFrame) -> DataFrame:
    """Adds ``temporal``: the share of the candidates' times up to the own; 0.5 without one, 1 for an only one.

    Candidates are a cut pool, so the window is over a bounded number of rows.
    """
    timed = F.col("acquisition_time").isNotNull()
    n = F.count("acquisition_time").over(Window.partitionBy())
    share = F.cume_dist().over(Window.partitionBy(timed).orderBy("acquisition_time"))
    return candidates.withColumn("temporal", F.when(~timed | (n == 0), F.lit(0.5)).when(n == 1, F.lit(1.0)).otherwise(share))


def reject_counts(results: DataFrame, reviews: DataFrame) -> DataFrame:
    """(tile_id, rejects): all reject reviews of a tile's results."""
    rejected = reviews.filter(F.col("decision") == "reject").select("result_id")
    return results.select("result_id", "tile_id").join(rejected, "result_id").groupBy("tile_id").agg(F.count("*").alias("rejects"))


def components(candidates: DataFrame, params: SearchParams) -> tuple[DataFrame, list[str]]:
    """Adds a column for each component, and names those that apply to the request."""
    where = params.where
    out = candidates.withColumns({
        "semantic": clip(F.col("sim")),
        "quality": F.coalesce("quality_score", F.lit(0.0)),
        "metadata": S.metadata_score(where.sensor, where.platform, params.context),
        "spatial": covered_fraction(where.bbox) if where.bbox else F.lit(0.0),
    })
    out = temporal_scores(out)
    applicable = ["semantic", "quality", "metadata"]
    applicable += ["spatial"] if where.bbox else []
    applicable += ["temporal"] if params.temporal_intent or where.date_from is not None or where.date_to is not None else []
    return out, applicable


def ranked(candidates: DataFrame, applicable: list[str], settings: Settings = DEFAULTS, penalty: Column | None = None) -> DataFrame:
    parts = {c: F.col(c) if c in candidates.columns else F.lit(0.0) for c in S.COMPONENTS}
    out = candidates.withColumn("final_score", S.final_score(settings.weights, applicable, parts, penalty))
    return out.withColumn("confidence", S.confidence(F.col("final_score"), applicable, parts))


def one_per_location(rows: DataFrame) -> DataFrame:
    """The best row of each location; an empty or null key stands for the tile alone."""
    key = F.coalesce(F.nullif(F.col("location_key").cast("string"), F.lit("")), F.col("tile_id").cast("string"))
    best = Window.partitionBy(key).orderBy(F.desc("final_score"), "tile_id")
    return rows.withColumn("_best", F.row_number().over(best)).filter("_best = 1").drop("_best")


def with_rank(rows: DataFrame, top_k: int) -> DataFrame:
    """The ``top_k`` rows by score with their ``rank``; cut before the window, so that it sees no more rows."""
    top = rows.orderBy(F.desc("final_score"), "tile_id").limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final_score"), "tile_id")))


def verified(candidates: DataFrame, detections: DataFrame, applicable: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Candidates of the first ``max_change_locations`` locations whose change is detected, from its onset on, with its score."""
    prelim = one_per_location(ranked(candidates, applicable, settings).filter("location_key is not null"))
    budget = prelim.orderBy(F.desc("final_score"), "tile_id").limit(settings.max_change_locations).select("location_key")
    found = detections.join(budget, "location_key", "left_semi").select("location_key", F.col("confidence").alias("change"), "earliest_supported_time", "change_type")
    joined = candidates.join(found, "location_key")
    early = F.col("acquisition_time") < F.col("earliest_supported_time")
    return joined.filter(~F.coalesce(early, F.lit(False)))


def search(tiles: DataFrame, embeddings: DataFrame, query: Column, params: SearchParams, settings: Settings = DEFAULTS, rejects: DataFrame | None = None, detections: DataFrame | None = None) -> DataFrame:
    """Ranked results of a query vector; ``detections`` asks for verified change."""
    check_top_k(params.top_k)
    if params.where.bbox:
        check_bbox(params.where.bbox, on_earth=False)
    check_dates(params.where.date_from, params.where.date_to)
    pool, applicable = components(similar(tiles, embeddings, query, params.top_k * settings.pool_factor, params.where, params.model), params)
    penalty = None
    if rejects is not None and settings.reject_penalty > 0:
        pool = pool.join(rejects, "tile_id", "left")
        penalty = S.reject_penalty(F.coalesce("rejects", F.lit(0)), settings.reject_penalty, settings.max_penalty)
    if detections is not None:
        applicable = [*applicable, "change"]
        pool = verified(pool, detections, applicable, settings)
    out = ranked(pool, applicable, settings, penalty)
    return with_rank(one_per_location(out) if params.group_by_location else out, params.top_k)


def similar_to_tile(tiles: DataFrame, embeddings: DataFrame, tile_id, params: SearchParams, settings: Settings = DEFAULTS) -> DataFrame:
    """Tiles like a stored one, without those of its location (without a location: without itself)."""
    own = tiles.filter(F.col("tile_id") == F.lit(tile_id)).select("tile_id", "location_key")
    first = embeddings.filter(F.col("tile_id") == F.lit(tile_id)).select("vector").head()
    if first is None:
        raise LookupError(f"no embedding for tile {tile_id!r}")
    here = tiles.join(own.filter("location_key is not null").select("location_key"), "location_key", "left_semi").select("tile_id").unionByName(own.select("tile_id")).distinct()
    params.where.exclude_tile_ids = here
    from ..functions.vectors import literal

    return search(tiles, embeddings, literal(first.vector), params, settings)


def stored_query(results: DataFrame, tiles: DataFrame, scenes: DataFrame, query_id: str) -> DataFrame:
    """The rows of a persisted query by rank, with tile and scene; its confidence is the final score."""
    rows = results.filter(F.col("query_id") == query_id).join(tiles.select("tile_id", "scene_id", "acquisition_time", "sensor", "platform", "geometry"), "tile_id")
    rows = rows.join(scenes.select("scene_id", "source_path", F.col("checksum").alias("source_checksum")), "scene_id", "left")
    return rows.withColumn("confidence", F.col("final_score")).orderBy("rank")


def change_types_for(asked: list[str], parsed: list[str]) -> list[str]:
    """The caller's types, or the parsed ones without plain appearance unless nothing else is there."""
    return asked or [t for t in parsed if t != "appearance"] or parsed
