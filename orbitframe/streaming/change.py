"""Change consensus as a stream: each location's observations are its state, and a location is looked at again when it gets new ones.

The consensus itself is the batch operator, over the locations that a micro-batch touches. State needs the RocksDB state store, which
:func:`start` chooses for the session; it is kept in the query's checkpoint, on a file system that all executors share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULTS, Settings
from ..operators import temporal

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OBSERVATION = "acquisition_time timestamp, quality_score double, usable_for_change boolean, score double, change_type string, registration double"
FIELDS = ("acquisition_time", "quality_score", "usable_for_change", "score", "change_type", "registration")
#: A location without a new observation for so long is closed, and its state is given back.
RETENTION_DAYS = 3650
#: An observation as the state holds it: times in microseconds, whatever the session's zone, and flags as numbers, so that columns with missing values keep their type.
PACKED = pa.schema([("tile_id", pa.int64()), ("micros", pa.int64()), ("quality_score", pa.float64()), ("usable", pa.int8()), ("score", pa.float64()), ("change_type", pa.string()), ("registration", pa.float64())])
NO_TIME = -(1 << 63)


class Series(StatefulProcessor):
    """Holds a location's observations, each tile's last one, and gives all of them whenever one is added.

    They are one value, an Arrow batch without its schema: a location is read and written once in a micro-batch, whatever its number of observations.
    An event-time timer after the latest observation and the retention ends the location; each new latest observation moves it.
    """

    def __init__(self, retention_days: int):
        self.retention = retention_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("series", "packed binary, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = [[batch[f.name].to_numpy() for batch in rows_of] for f in PACKED] if (rows_of := list(rows)) else []
        new = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if len(c) > 1 else c[0], f.type, from_pandas=True) for c, f in zip(columns, PACKED, strict=True)], schema=PACKED)
        held, timer = self.held.get() or (None, None)
        if held is not None:
            new = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(held), PACKED), new]).combine_chunks().to_batches()[0]
        tiles = new.column("tile_id").to_numpy()
        last = len(tiles) - 1 - np.unique(tiles[::-1], return_index=True)[1]  # where each tile came last
        if len(last) < len(tiles):
            new = new.take(pa.array(last))
        latest = int(new.column("micros").to_numpy().max())
        due = None if latest == NO_TIME else latest // 1000 + self.retention
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.held.update((new.serialize().to_pybytes(), due))
        yield pd.DataFrame({"location_key": np.full(new.num_rows, key[0]), **{name: c.to_numpy(zero_copy_only=False) for name, c in zip(PACKED.names, new.columns, strict=True)}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def series(observations: DataFrame, delay: str = "30 days", retention_days: int = RETENTION_DAYS) -> DataFrame:
    """All observations of each location that a micro-batch adds to: ``location_key, tile_id`` and the columns of OBSERVATION.

    Rows later than ``delay`` behind the latest time are left out. ``observations`` is a stream with integer location and tile ids.
    """
    timed = observations.withColumn("acquisition_time", F.col("acquisition_time").cast("timestamp")).withWatermark("acquisition_time", delay)
    micros, usable = F.coalesce(F.unix_micros("acquisition_time"), F.lit(NO_TIME)), F.coalesce(F.col("usable_for_change").cast("tinyint"), F.lit(-1).cast("tinyint"))
    flat = timed.select(F.col("location_key").cast("long").alias("location_key"), F.col("tile_id").cast("long").alias("tile_id"), "acquisition_time", micros.alias("micros"), "quality_score", usable.alias("usable"), "score", "change_type", "registration")
    kinds = "location_key long, tile_id long, micros long, quality_score double, usable tinyint, score double, change_type string, registration double"
    held = flat.groupBy("location_key").transformWithStateInPandas(statefulProcessor=Series(retention_days), outputStructType=kinds, outputMode="Update", timeMode="EventTime")
    there = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return held.select("location_key", "tile_id", F.timestamp_micros(F.nullif("micros", F.lit(NO_TIME))).alias("acquisition_time"), there("quality_score"), F.nullif("usable", F.lit(-1)).cast("boolean").alias("usable_for_change"), there("score"), "change_type", there("registration"))


def start(observations: DataFrame, results: str, checkpoint: str, min_quality: float | None = None, delay: str = "30 days", retention_days: int = RETENTION_DAYS, settings: Settings = DEFAULTS) -> StreamingQuery:
    """Keeps ``results``, a folder with a part for each micro-batch: its locations with their change, or without one.

    A batch that runs again after a failure overwrites its own part.
    """
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def judge(batch: DataFrame, number: int) -> None:
        batch.persist()  # the state is gone through once, though the plan below has the batch twice
        try:
            touched = batch.select("location_key").distinct()
            found = temporal.consensus(temporal.pairs(batch, settings, min_quality), settings)
            touched.join(found, "location_key", "left").write.mode("overwrite").parquet(f"{results}/batch={number}")
        finally:
            batch.unpersist()

    stream = series(observations, delay, retention_days)
    return stream.writeStream.foreachBatch(judge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, results: str) -> DataFrame:
    """The changes as of now: of each location what the last batch that touched it found, if it found any."""
    rows = spark.read.option("mergeSchema", True).parquet(results)
    last = rows.groupBy("location_key").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("location_key", "batch")]), "batch").alias("r"))
    return last.select("location_key", "r.*").filter("confidence is not null")


def unique_scenes(scenes: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream of ``scenes(checksum, seen_at, ...)`` without repetitions of a checksum within ``delay``; state is given back after it."""
    return scenes.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["checksum"])


