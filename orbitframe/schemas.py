"""Schemas of the entity tables (Spark DDL), read explicitly and never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BBOX = "min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE"
QUALITY = (
    "STRUCT<cloud_score:DOUBLE,haze_score:DOUBLE,snow_score:DOUBLE,shadow_score:DOUBLE,valid_pixel_ratio:DOUBLE,registration_quality:DOUBLE,"
    "radiometric_quality:DOUBLE,overall_quality:DOUBLE,usable_for_change_detection:BOOLEAN,clear_ratio:DOUBLE,features:MAP<STRING,DOUBLE>>"
)
TABLES = {
    "scene": f"scene_id STRING, source_path STRING, filename STRING, sensor STRING, platform STRING, acquisition_time TIMESTAMP, processing_level STRING, crs STRING, resolution DOUBLE, width INT, height INT, bands INT, geometry STRING, cloud_percentage DOUBLE, quality_score DOUBLE, checksum STRING, ingestion_timestamp TIMESTAMP, status STRING, metadata_json STRING, {BBOX}",
    "tile": f"tile_id STRING, scene_id STRING, geometry STRING, x_index INT, y_index INT, width INT, height INT, raster_path STRING, thumbnail_path STRING, mask_path STRING, quality_score DOUBLE, cloud_percentage DOUBLE, valid_pixel_percentage DOUBLE, quality_json {QUALITY}, location_key STRING, acquisition_time TIMESTAMP, sensor STRING, platform STRING, created_at TIMESTAMP, {BBOX}",
    "embedding": "tile_id STRING, embedding_type STRING, model_name STRING, model_version STRING, dimension INT, vector_id BIGINT, vector_path STRING, vector ARRAY<FLOAT>, created_at TIMESTAMP",
    "temporal_observation": f"tile_id STRING, location_key STRING, location STRING, acquisition_time TIMESTAMP, scene_id STRING, quality_score DOUBLE, usable_for_change BOOLEAN, {BBOX}",
    "pair_statistics": "location_key STRING, before_tile_id STRING, after_tile_id STRING, seq INT, score DOUBLE, raw_score DOUBLE, changed_fraction DOUBLE, change_type STRING, type_scores MAP<STRING,DOUBLE>, factors MAP<STRING,DOUBLE>, mask_bbox STRUCT<r0:INT,r1:INT,c0:INT,c1:INT>",
    "change_analysis": f"analysis_id STRING, request_id STRING, geometry STRING, location_key STRING, start_time TIMESTAMP, end_time TIMESTAMP, earliest_supported_time TIMESTAMP, change_type STRING, confidence DOUBLE, quality_score DOUBLE, status STRING, model_name STRING, model_version STRING, factors_json STRING, created_at TIMESTAMP, {BBOX}",
    "change_evidence": "analysis_id STRING, before_tile_id STRING, after_tile_id STRING, before_time TIMESTAMP, after_time TIMESTAMP, evidence_score DOUBLE, processing_metadata STRING",
    "search_query": "query_id STRING, query_text STRING, query_type STRING, filters_json STRING, parsed_json STRING, embedding_model STRING, created_at TIMESTAMP",
    "search_result": "result_id STRING, query_id STRING, tile_id STRING, change_analysis_id STRING, semantic_score DOUBLE, metadata_score DOUBLE, quality_score DOUBLE, change_score DOUBLE, spatial_score DOUBLE, temporal_score DOUBLE, final_score DOUBLE, rank INT, status STRING",
    "analyst_review": "review_id STRING, query_id STRING, result_id STRING, result_type STRING, decision STRING, comment STRING, analyst_id STRING, timestamp TIMESTAMP, context_json STRING",
    "provenance_record": "entity_type STRING, entity_id STRING, source_scene_id STRING, source_path STRING, source_checksum STRING, processing_step STRING, preprocessing_version STRING, embedding_model STRING, embedding_version STRING, change_model STRING, change_model_version STRING, parameters_json STRING, parent_entity STRING, created_at TIMESTAMP",
    "model_registry": "model_name STRING, version STRING, type STRING, local_path STRING, checksum STRING, license STRING, source STRING, input_schema STRING, output_schema STRING, active BOOLEAN, registered_at TIMESTAMP",
    "job": "job_id STRING, job_type STRING, status STRING, progress DOUBLE, params_json STRING, result_json STRING, error STRING, created_at TIMESTAMP, started_at TIMESTAMP, finished_at TIMESTAMP",
    "pixel": "tile_id STRING, location_key STRING, row INT, col INT, blue DOUBLE, green DOUBLE, red DOUBLE, nir DOUBLE, valid BOOLEAN",
}
#: The unique key of each table that has one.
KEYS = {
    "scene": ["scene_id"], "tile": ["tile_id"], "embedding": ["tile_id", "model_name", "model_version", "embedding_type"], "temporal_observation": ["tile_id"],
    "change_analysis": ["analysis_id"], "search_query": ["query_id"], "search_result": ["result_id"], "analyst_review": ["review_id"], "model_registry": ["model_name", "version"], "job": ["job_id"],
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
