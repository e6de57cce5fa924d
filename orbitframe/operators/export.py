"""Results as GeoJSON, JSON and CSV.

Features are made as one JSON text a row, so a result of any size is written by all tasks
(a text file of features); one document is only made of a request's own few results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.spatial import geojson
from ..functions.times import iso

# The columns of the export formats, in order.
SEARCH_COLUMNS = ["rank", "result_id", "tile_id", "scene_id", "acquisition_time", "sensor", "platform", "semantic_score", "quality_score", "metadata_score", "change_score", "final_score", "change_analysis_id", "status", "bbox", "source_path", "source_checksum", "embedding_model", "embedding_version", "preprocessing_version", "provenance_href"]
CHANGE_COLUMNS = ["analysis_id", "change_type", "confidence", "earliest_supported_time", "before_scene", "after_scene", "before_tile", "after_tile", "before_time", "after_time", "evidence_score", "change_model", "change_model_version", "source_paths", "source_checksums", "provenance_href"]


def href(kind: str, id_col: str) -> Column:
    return F.concat(F.lit(f"/api/v1/provenance/{kind}/"), F.col(id_col).cast("string"))


def _json_struct(rows: DataFrame, leave: set[str]) -> Column:
    times = {f.name for f in rows.schema if f.dataType.typeName().startswith("timestamp")}
    return F.to_json(F.struct(*[iso(F.col(c)).alias(c) if c in times else F.col(c) for c in rows.columns if c not in leave]), {"ignoreNullFields": "false"})


def features(rows: DataFrame, id_col: str, geometry_col: str = "geometry") -> DataFrame:
    """(id, feature): a GeoJSON feature of each row, its other columns as properties."""
    geometry = F.coalesce(geojson(F.col(geometry_col)), F.lit("null"))
    name = F.to_json(F.struct(F.col(id_col).cast("string").alias("id")))
    feature = F.concat(F.lit('{"type":"Feature",'), F.substring(name, F.lit(2), F.length(name) - 2), F.lit(',"geometry":'), geometry, F.lit(',"properties":'), _json_struct(rows, {geometry_col}), F.lit("}"))
    return rows.select(F.col(id_col).alias("id"), feature.alias("feature"))


def feature_collection(rows: DataFrame, id_col: str, order: str, properties: str = "{}") -> DataFrame:
    """One row with the whole document; for a request's results, which are few (:func:`write_features` is for any number)."""
    made = features(rows.select("*"), id_col).join(rows.select(F.col(id_col).alias("id"), F.col(order).alias("_o")), "id")
    sorted_features = F.transform(F.array_sort(F.collect_list(F.struct("_o", "id", "feature"))), lambda x: x["feature"])
    return made.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(sorted_features, ","), F.lit(f'],"properties":{properties}}}')).alias("document"))


def search_rows(results: DataFrame) -> DataFrame:
    """The columns of a search's CSV; those a result lacks are null."""
    box = F.when(F.col("min_x").isNotNull(), F.to_json(F.array("min_x", "min_y", "max_x", "max_y"))) if "min_x" in results.columns else F.lit(None)
    out = results.withColumns({"bbox": box, "provenance_href": href("search_result", "result_id")})
    pick = lambda c: (iso(F.col(c)) if c == "acquisition_time" else F.col(c)) if c in out.columns else F.lit(None).cast("string")
    return out.select(*[pick(c).alias(c) for c in SEARCH_COLUMNS])


def evidence_by_time(evidence: DataFrame) -> DataFrame:
    """``evidence`` with ``place``: the order of an analysis' pairs by the time of the later tile (those without one first), from 1."""
    order = Window.partitionBy("analysis_id").orderBy(F.asc_nulls_first("after_time"), "after_tile_id")
    return evidence.withColumn("place", F.row_number().over(order))


def change_rows(analyses: DataFrame, evidence: DataFrame, tiles: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row for each pair of evidence, with the sources of the analysis joined by semicolons."""
    scene_of = tiles.select("tile_id", "scene_id")
    pairs = evidence
    for side in ("before", "after"):
        pairs = pairs.join(scene_of.select(F.col("tile_id").alias(f"{side}_tile_id"), F.col("scene_id").alias(f"{side}_scene")), f"{side}_tile_id", "left")
    used = pairs.select("analysis_id", F.explode(F.array("before_scene", "after_scene")).alias("scene_id")).distinct().join(scenes.select("scene_id", "source_path", "checksum"), "scene_id")
    ordered = F.array_sort(F.collect_list(F.struct("scene_id", "source_path", "checksum")))  # a location's scenes
    sources = used.groupBy("analysis_id").agg(ordered.alias("s")).select("analysis_id", F.array_join("s.source_path", ";").alias("source_paths"), F.array_join("s.checksum", ";").alias("source_checksums"))
    out = analyses.join(pairs, "analysis_id").join(sources, "analysis_id", "left")
    out = out.withColumns({"before_tile": F.col("before_tile_id"), "after_tile": F.col("after_tile_id"), "change_model": F.col("model_name"), "change_model_version": F.col("model_version"), "provenance_href": href("change_analysis", "analysis_id")})
    times = ("earliest_supported_time", "before_time", "after_time")
    return out.select(*[(iso(F.col(c)) if c in times else F.col(c)).alias(c) for c in CHANGE_COLUMNS])


def of_request(analyses: DataFrame, request_id: str) -> DataFrame:
    return analyses.filter(F.col("request_id") == request_id).select("analysis_id")


def write_features(rows: DataFrame, id_col: str, path: str) -> None:
    """Newline-delimited GeoJSON."""
    features(rows, id_col).select("feature").write.text(path)


def write_csv(rows: DataFrame, path: str, comment: str | None = None) -> None:
    """CSV files with a header; a comment goes to a file of its own beside them."""
    rows.write.option("header", True).csv(path)
    if comment:
        rows.sparkSession.createDataFrame([(f"# {comment}",)], "line string").coalesce(1).write.text(f"{path}.about")
