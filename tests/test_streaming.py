"""The stream of change consensus against the batch operator."""

import datetime as dt
import random

from pyspark.sql import functions as F

from orbitframe.operators import temporal
from orbitframe.streaming import change

SCHEMA = "location_key long, tile_id long, acquisition_time timestamp, quality_score double, usable_for_change boolean, score double, change_type string, registration double"
DAY0 = dt.datetime(2024, 1, 1)


def made(rng, first, last, tiles):
    out = []
    for t in tiles:
        out.append((rng.randint(1, 6), t, DAY0 + dt.timedelta(days=rng.randint(first, last), hours=t % 24), rng.choice([None, 0.4, 0.7, 0.9]), rng.random() > 0.1, round(rng.random() / 2, 3), rng.choice(["construction", "clearance"]), 1.0))
    return out


def plain(rows):
    return sorted((r.location_key, r.change_type, r.earliest_tile_id, r.n_support, r.n_after, round(r.confidence, 9)) for r in rows.collect())


def test_stream_gives_the_batch_consensus(spark, tmp_path):
    """Three runs over growing files from one checkpoint; a tile that comes again, and a late row that doesn't count."""
    rng = random.Random(1)
    folder, results, checkpoint = (str(tmp_path / n) for n in ("in", "results", "checkpoint"))
    parts = [made(rng, 0, 20, range(0, 30)), made(rng, 10, 40, range(30, 60)), made(rng, 35, 60, range(60, 80))]
    parts[1].append(parts[0][3])  # seen before
    late = (2, 500, DAY0 - dt.timedelta(days=400), 0.9, True, 0.5, "clearance", 1.0)
    kept = []
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows + ([late] if k == 2 else []), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        kept += rows
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        change.start(stream, results, checkpoint, min_quality=0.3, delay="30 days").awaitTermination()
        batch = spark.createDataFrame(kept, SCHEMA).dropDuplicates(["tile_id"])
        want = temporal.consensus(temporal.pairs(batch, min_quality=0.3))
        assert plain(change.current(spark, results)) == plain(want) and want.count() > 2


def test_locations_end_after_their_retention(spark, tmp_path):
    """A location that the watermark leaves behind begins anew."""
    folder, results, checkpoint = (str(tmp_path / n) for n in ("in", "results", "checkpoint"))
    row = lambda loc, tile, day: (loc, tile, DAY0 + dt.timedelta(days=day), 0.9, True, 0.5, "clearance", 1.0)
    for rows in ([row(1, 1, 0), row(1, 2, 1)], [row(2, 3, 100)], [row(2, 4, 101)], [row(1, 5, 102)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        change.start(stream, results, checkpoint, min_quality=0.3, delay="1 day", retention_days=10).awaitTermination()
    assert [r.location_key for r in change.current(spark, results).collect()] == [2]


def test_scenes_once_within_the_delay(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", DAY0), ("b", DAY0)], [("a", DAY0 + dt.timedelta(hours=5)), ("c", DAY0)]):
        spark.createDataFrame(rows, "checksum string, seen_at timestamp").coalesce(1).write.mode("append").parquet(folder)
        stream = change.unique_scenes(spark.readStream.schema("checksum string, seen_at timestamp").parquet(folder), "1 day")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(r.checksum for r in spark.read.parquet(out).select(F.col("checksum")).collect()) == ["a", "b", "c"]
