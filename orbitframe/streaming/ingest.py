"""Streams: scene ingestion by micro-batches, and windows over event tables.

The catalogue's own work is batch; these run the same functions on new files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import scene_id
from ..operators.tables import Store


def scene_stream(spark: SparkSession, folder: str, glob: str = "*.tif") -> DataFrame:
    """New files of a folder as (path, checksum, scene_id, size)."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY").load(folder)
    return files.select("path", F.sha2("content", 256).alias("checksum"), F.col("length").alias("size")).withColumn("scene_id", scene_id(F.col("checksum")))


def ingest(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Adds each new scene once: a batch that runs again finds its scenes there and adds none."""

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates(["checksum"]).withColumns({"source_path": F.col("path"), "status": F.lit("complete")})
        store.insert_new("scene", rows)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_windows(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and sums by time window and type; works on a stream (late rows within the delay count) and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", delay) if timed.isStreaming else timed
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
