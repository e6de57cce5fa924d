"""The given tables seen as the catalogue's entities, in Spark and in SQL.

``embeddings`` and ``events`` together are tiles with vectors, ``events`` alone observations,
``orders`` and ``lineitem`` results and reviews, ``lineitem`` pixels, and the sales hierarchy a lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> F.Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("double")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    x, y = (F.col("user_id") % 36) * 10.0 - 180, (F.col("user_id") % 18) * 10.0 - 90
    return e.select(
        F.col("event_id").alias("tile_id"), F.col("event_type").alias("sensor"), F.upper("event_type").alias("platform"), F.col("user_id").alias("location_key"), F.col("ts").alias("acquisition_time"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("quality_score"), _k().alias("cloud_percentage"), (100 - _k() / 2).alias("valid_pixel_percentage"),
        x.alias("min_x"), y.alias("min_y"), (x + 10).alias("max_x"), (y + 10).alias("max_y"),
    )


TILES = """tiles AS (
  SELECT event_id AS tile_id, event_type AS sensor, upper(event_type) AS platform, user_id AS location_key, ts AS acquisition_time,
         least(value / 100, 1.0) AS quality_score, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS cloud_percentage,
         100 - CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 2 AS valid_pixel_percentage,
         (user_id % 36) * 10.0::DOUBLE - 180 AS min_x, (user_id % 18) * 10.0::DOUBLE - 90 AS min_y,
         (user_id % 36) * 10.0::DOUBLE - 170 AS max_x, (user_id % 18) * 10.0::DOUBLE - 80 AS max_y
  FROM events)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile_id"), F.col("vec_id").alias("vector_id"), F.col("embedding").alias("vector"), "label")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations_of(table(spark, sf_dir, "events"))


def observations_of(events: DataFrame) -> DataFrame:
    """Observations with the score and type that a pair ending there would have; ``events`` may be a stream."""
    return events.select(F.col("event_id").alias("tile_id"), F.col("user_id").alias("location_key"), F.col("ts").alias("acquisition_time"), F.least(F.col("value") / 100, F.lit(1.0)).alias("quality_score"), (_k() >= 5).alias("usable_for_change"), (_k() / 100).alias("score"), F.col("event_type").alias("change_type"), F.lit(1.0).alias("registration"))


OBSERVATIONS = """observations AS (
  SELECT event_id AS tile_id, user_id AS location_key, ts AS acquisition_time, least(value / 100, 1.0) AS quality_score,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) >= 5 AS usable,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS score, event_type AS change_type
  FROM events)"""

RESULT_ID = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
DECISION = "CASE l_returnflag WHEN 'A' THEN 'accept' WHEN 'R' THEN 'reject' ELSE 'uncertain' END"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of (part, supplier) results by line items; an order is a query."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.expr(RESULT_ID).alias("review_id"), F.expr("concat_ws('-', l_partkey % 200, l_suppkey)").alias("result_id"), F.col("l_orderkey").alias("query_id"), F.expr(DECISION).alias("decision"),
        F.col("l_suppkey").alias("analyst_id"), F.col("l_shipdate").alias("timestamp"), (F.col("l_discount") * 10).alias("score"),
        F.when(F.col("l_linestatus") == "O", F.lit("change_analysis")).otherwise(F.lit("search_result")).alias("result_type"), F.when(F.col("l_linenumber") <= 4, F.concat(F.lit("type_"), F.col("l_linenumber").cast("string"))).alias("change_type"),
    )


REVIEWS = f"""reviews AS (
  SELECT {RESULT_ID} AS review_id, concat_ws('-', l_partkey % 200, l_suppkey) AS result_id, l_orderkey AS query_id, {DECISION} AS decision,
         l_suppkey AS analyst_id, l_shipdate AS timestamp, l_discount * 10 AS score,
         CASE WHEN l_linestatus = 'O' THEN 'change_analysis' ELSE 'search_result' END AS result_type,
         CASE WHEN l_linenumber <= 4 THEN 'type_' || l_linenumber END AS change_type
  FROM lineitem)"""


def pixels(spark: SparkSession, sf_dir: str, tiles: int = 32) -> DataFrame:
    """Line items as pixels: a supplier's remainder is the tile, the order the row, the part the column."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        (F.col("l_suppkey") % tiles).alias("tile_id"), F.col("l_orderkey").alias("row"), F.struct("l_partkey", "l_linenumber").alias("col"),
        (F.col("l_quantity") / 50).alias("blue"), (F.col("l_tax") * 10).alias("green"), (F.col("l_discount") * 8).alias("red"), (F.col("l_quantity") / 60).alias("nir"), (F.col("l_linenumber") < 7).alias("valid"),
    )


PIXELS = """pixels AS (
  SELECT l_suppkey % 32 AS tile_id, l_quantity / 50 AS blue, l_tax * 10 AS green, l_discount * 8 AS red, l_quantity / 60 AS nir, l_linenumber < 7 AS valid
  FROM lineitem)"""
