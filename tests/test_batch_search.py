"""Search for many queries gives what a search for each gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orbitframe.functions.vectors import literal
from orbitframe.operators import batch_search, search
from orbitframe.operators.encoders import encode_text
from orbitframe.operators.filters import TileFilter

START = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows, vectors = [], []
    for k in range(300):
        x, y = rng.uniform(-20, 20), rng.uniform(-20, 20)
        rows.append((f"t{k}", rng.choice(["MSI", "OLI", None]), rng.choice(["Sentinel-2A", "landsat-8"]), rng.choice([None, "", *[f"loc{i}" for i in range(40)]]), rng.choice([None, START + dt.timedelta(days=rng.randint(0, 900))]), rng.choice([None, rng.random()]), rng.uniform(0, 100), rng.uniform(50, 100), x, y, x + 2, y + 2))
        vectors.append((f"t{k}", k, vectors[-1][2] if k % 50 == 1 else [rng.gauss(0, 1) for _ in range(8)]))
    names = "tile_id string, sensor string, platform string, location_key string, acquisition_time timestamp, quality_score double, cloud_percentage double, valid_pixel_percentage double, min_x double, min_y double, max_x double, max_y double"
    return spark.createDataFrame(rows, names).repartition(5), spark.createDataFrame(vectors, "tile_id string, vector_id long, vector array<double>")


TEXTS = [(1, "new buildings near a river since 2021"), (2, "forest"), (3, "snow before 2021"), (4, "ships along the coast"), (5, "  "), (6, None)]


def test_text_queries(spark, tables):
    """Texts go through parsing, encoding, filters and ranking as one query at a time does."""
    tiles, vectors = tables
    texts = spark.createDataFrame(TEXTS, "query_id long, text string").withColumn("sensor", F.when(F.col("query_id") == 2, F.lit("msi"))).withColumn("q_min_x", F.when(F.col("query_id") == 4, F.lit(-10.0)))
    texts = texts.withColumns({c: F.when(F.col("query_id") == 4, F.lit(v)) for c, v in (("q_min_y", -10.0), ("q_max_x", 15.0), ("q_max_y", 12.0))})
    got = {}
    for r in batch_search.search_texts(texts, tiles, vectors, top_k=7, dim=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.tile_id, round(r.final_score, 9), round(r.confidence, 9)))
    asked = [
        (1, "built structures near river", True, TileFilter(date_from=dt.datetime(2021, 1, 1))), (2, "vegetation", False, TileFilter(sensor="MSI")), (3, "snow", True, TileFilter(date_to=dt.datetime(2021, 1, 1))),
        (4, "vessel along coast", False, TileFilter(bbox=[-10.0, -10.0, 15.0, 12.0])),
    ]
    assert set(got) == {1, 2, 3, 4}
    for k, text, temporal, where in asked:
        params = search.SearchParams(top_k=7, where=where, temporal_intent=temporal)
        want = search.search(tiles, vectors, literal(encode_text(text, 8)), params).collect()
        assert sorted(got[k]) == sorted((r["rank"], r.tile_id, round(r.final_score, 9), round(r.confidence, 9)) for r in want), k


@pytest.mark.parametrize("block", [1, 3, 100])
def test_pools_in_blocks(spark, tables, block):
    tiles, vectors = tables
    rng = random.Random(2)
    queries = spark.createDataFrame([(f"q{k}", [rng.gauss(0, 1) for _ in range(8)], rng.choice([None, 0.3])) for k in range(9)], "query_id string, vector array<double>, min_quality double")
    got = {}
    for r in batch_search.batch_pools(queries, tiles, vectors, 5, block).collect():
        got.setdefault(r.query_id, set()).add((r.tile_id, round(r.sim, 9)))
    for q in queries.collect():
        want = search.similar(tiles, vectors, literal(q.vector), 5, TileFilter(min_quality=q.min_quality)).collect()
        assert got[q.query_id] == {(r.tile_id, round(r.sim, 9)) for r in want}
    assert batch_search.batch_pools(queries.limit(0), tiles, vectors, 5).collect() == []
    assert batch_search.batch_pools(queries, tiles.limit(0), vectors, 5).collect() == []
