"""Operators on small inputs with known answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from orbitframe import schemas
from orbitframe.functions import scores, spatial, text, times, vectors
from orbitframe.operators import clusters, encoders, evaluation, export, filters, lineage, pixels, review, search, tables, temporal
from orbitframe.sources import files
from orbitframe.streaming import ingest

UTC = dt.timezone.utc


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


@pytest.mark.parametrize(
    ("flags", "last_quality", "onset", "transient", "confidence"),
    [([0, 1, 1, 1], 0.9, 2, False, 0.72), ([0, 0, 0, 1], 0.55, 4, False, 0.31465), ([1, 0, 0, 0], 0.9, 1, True, 0.05985)],
)
def test_consensus_scenarios(spark, flags, last_quality, onset, transient, confidence):
    day = lambda k: dt.datetime(2023, 1, 1) + dt.timedelta(days=30 * k)
    rows = [(f"t{k}", "loc", day(k), 0.9 if k < 4 else last_quality, True) for k in range(5)]
    obs = spark.createDataFrame(rows, "tile_id string, location_key string, acquisition_time timestamp, quality_score double, usable_for_change boolean")
    pairs = temporal.pairs(obs)
    score = F.get(F.array(*[F.lit(0.8 * f) for f in flags]), F.col("pair"))
    scored = pairs.withColumns({"score": score, "change_type": F.lit("construction"), "registration": F.lit(1.0)})
    (row,) = temporal.consensus(scored).collect()
    assert row.earliest_tile_id == f"t{onset}"
    assert row.last_unchanged_tile_id == f"t{onset - 1}"
    assert row.transient is transient
    assert row.confidence == pytest.approx(confidence, abs=1e-9)


def test_pairs_are_gated_and_capped(spark):
    rows = [(f"{k:02d}", "a", dt.datetime(2023, 1, 1 + k), 0.9 if k else None, True) for k in range(15)] + [("x", "b", None, 0.9, True)]
    obs = spark.createDataFrame(rows, "tile_id string, location_key string, acquisition_time timestamp, quality_score double, usable_for_change boolean")
    got = values(temporal.pairs(obs).orderBy("pair"), "ref_tile_id", "tile_id")
    assert got == [("01", t) for t in ("02", "04", "07", "09", "12", "14")]
    (d,) = temporal.diagnostics(obs).collect()
    assert (d.observations, d.locations, d.dropped_low_quality, d.locations_insufficient, d.pairs_evaluated) == (16, 2, 1, 1, 6)


def test_query_parser(spark):
    now = F.lit(dt.datetime(2024, 6, 1))
    texts = ["newly built structures near a river", "flooding along the coast between 2019 and 2021", "New  road by the forest, last 2 weeks", "", "boats since 2020 until 2022", None]
    rows = text.parse_queries(spark.createDataFrame([(t,) for t in texts], "text string"), now).collect()
    a, b, c, d, e, _ = rows
    assert (a.objects, a.context, a.spatial_relation, a.change_types, a.change_intent, a.temporal_intent) == (["built structures"], ["river"], "near", ["construction"], "appearance/construction", True)
    assert a.embedding_text == "built structures near river"
    assert (b.objects, b.date_from, b.date_to, b.change_types) == (["water"], dt.datetime(2019, 1, 1), dt.datetime(2021, 12, 31, 23, 59), ["water_extent_change"])
    assert c.change_types == ["road_development", "construction", "appearance"]
    assert (c.context, c.spatial_relation, c.date_from) == (["forest"], "by", dt.datetime(2024, 5, 18))
    assert (d.objects, d.semantic_concepts, d.temporal_intent) == ([], [], False)
    assert (e.date_from, e.date_to, e.objects) == (dt.datetime(2020, 1, 1), dt.datetime(2022, 1, 1), ["vessel"])


def test_ranker_renormalises(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.2, 1.0)], "tile_id string, semantic double, quality double")
    parts = {c: F.col(c) if c in df.columns else F.lit(0.0) for c in scores.COMPONENTS}
    weights = {"semantic": 0.5, "quality": 0.25, "change": 0.25}
    final = scores.final_score(weights, ["semantic", "quality"], parts)
    assert [r[0] for r in df.select(final).collect()] == [1.0, pytest.approx(0.4666666667)]
    assert df.select(scores.final_score({}, ["semantic"], parts, F.lit(0.5))).first()[0] == 1.0


def test_filters_and_validation(spark):
    df = spark.createDataFrame([("a", None, 0.5, 10.0, "MSI", 0.0, 0.0, 1.0, 1.0), ("b", dt.datetime(2024, 1, 1), None, 0.0, "x", 5.0, 5.0, 6.0, 6.0)], "tile_id string, acquisition_time timestamp, quality_score double, cloud_percentage double, sensor string, min_x double, min_y double, max_x double, max_y double")
    ids = lambda f: sorted(r.tile_id for r in f.apply(df).collect())
    assert ids(filters.TileFilter(bbox=[1, 1, 2, 2])) == ["a"]
    assert ids(filters.TileFilter(date_from=dt.datetime(2024, 1, 1))) == ["b"]
    assert ids(filters.TileFilter(min_quality=0.0)) == ["a"]
    assert ids(filters.TileFilter(sensor="msi")) == ["a"]
    assert ids(filters.TileFilter(exclude_tile_ids=df.filter("tile_id = 'a'"))) == ["b"]
    assert filters.TileFilter(min_quality=0.0, exclude_tile_ids=["a"]).is_empty() and not filters.TileFilter(max_cloud=0.0).is_empty()
    for bad in (lambda: filters.check_bbox([0, 0, 200, 1]), lambda: filters.check_top_k(0), lambda: filters.check_dates(2, 1), lambda: filters.check_dates(1, 1, False)):
        with pytest.raises(filters.InvalidRequest):
            bad()


def test_temporal_score_counts_peers(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    df = spark.createDataFrame([("a", day(1)), ("b", day(2)), ("c", day(2)), ("d", None)], "tile_id string, acquisition_time timestamp")
    assert dict(values(search.temporal_scores(df), "tile_id", "temporal")) == {"a": pytest.approx(1 / 3), "b": 1.0, "c": 1.0, "d": 0.5}


def test_pushed_filters(spark, sf_dir):
    from orbitframe.plans import proxies

    where = filters.TileFilter(date_from=dt.datetime(2024, 1, 5))
    plan = where.apply(spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("ts", "acquisition_time"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    top = search.similar(proxies.tiles(spark, sf_dir), proxies.embeddings(spark, sf_dir), vectors.literal([1.0] * 64), 5, where)
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().toString()


def test_numbers_keys_and_boxes(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (10.0, 0.5, 1234567.0, 0.00001, 30.0, 0.0)], "x double").select(spatial.general_number(F.col("x"))).collect()]
    assert got == [f"{x:g}" for x in (10.0, 0.5, 1234567.0, 0.00001, 30.0, 0.0)]
    one = spark.range(1)
    cells = one.select(spatial.grid_cells(F.lit(499200.0), F.lit(1395200.0), F.lit(504320.0), F.lit(1400320.0), F.lit(10.0), 256)).first()[0]
    assert [(c.gx, c.gy) for c in cells] == [(195, 546), (196, 546), (195, 545), (196, 545)]
    lon, lat = one.select(spatial.to_wgs84(F.lit(32643), F.lit(500000.0), F.lit(1400000.0)).alias("p")).select("p.*").first()
    assert lon == pytest.approx(75.0) and lat == pytest.approx(12.6643, abs=1e-3)
    assert one.select(spatial.to_wgs84(F.lit(2154), F.lit(1.0), F.lit(1.0))).first()[0] is None
    wkt = spatial.wkt_box(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    box, gj = one.select(spatial.wkt_bounds(wkt), spatial.geojson(wkt)).first()
    assert tuple(box) == (0.0, 1.0, 2.0, 3.0) and gj.startswith('{"type":"Polygon","coordinates":[[[2.0,1.0]')
    assert one.select(spatial.geojson(F.lit(""))).first()[0] is None


def test_datetimes(spark):
    texts = ["2023-01-10T10:00:00Z", "2023-01-10", "20230110", "S2A_20230110T101010_x", "x 2023:01:10 01:02:03", "LC08_20230110", "nothing", "20231345"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(times.parse_datetime(F.col("t"))).collect()]
    assert got == [dt.datetime(2023, 1, 10, 10), dt.datetime(2023, 1, 10), dt.datetime(2023, 1, 10), dt.datetime(2023, 1, 10, 10, 10, 10), dt.datetime(2023, 1, 10, 1, 2, 3), dt.datetime(2023, 1, 10), None, None]
    gap = spark.range(1).select(times.day_gap(F.lit(dt.date(2023, 1, 5)), F.lit(dt.date(2022, 12, 30)))).first()[0]
    assert gap == 6


SCHEMA = "tile_id string, row int, col int, blue double, green double, red double, nir double, valid boolean"


def scene(tile, kind, size=24):
    """A vegetated tile; ``kind`` puts bright built blocks or a cloud in its middle."""
    rows = []
    for r in range(size):
        for c in range(size):
            noise = ((r * 31 + c * 17) % 7) / 1000
            px = (0.04 + noise, 0.08 + noise, 0.05 + noise, 0.35 + noise)
            inner = 6 <= r < 18 and 6 <= c < 18
            if kind == "built" and inner:
                px = (0.12,) * 3 + (0.13,) if r % 4 == 0 or c % 4 == 0 else (0.22, 0.24, 0.26, 0.28)
            if kind == "cloud" and 2 <= r < 22 and 2 <= c < 22:
                px = (0.85,) * 4
            if kind == "brighter":
                px = tuple(min(1.0, x * 1.3 + 0.01) for x in px)
            rows.append((tile, r, c, *px, True))
    return rows


def test_tile_quality(spark):
    rows = scene("clear", "") + scene("cloud", "cloud") + [(t, 0, 0, 0.0, 0.0, 0.0, 0.0, False) for t in ("void",)]
    q = {r.tile_id: r for r in pixels.tile_quality(pixels.with_classes(pixels.with_indices(spark.createDataFrame(rows, SCHEMA)))).collect()}
    assert q["clear"].cloud_score < 0.05 and q["clear"].usable_for_change_detection
    assert q["cloud"].cloud_score > 0.5 and not q["cloud"].usable_for_change_detection
    assert q["void"].overall_quality == 0 and not q["void"].usable_for_change_detection


def test_pair_scores(spark):
    rows = scene("a", "") + scene("same", "") + scene("built", "built") + scene("brighter", "brighter")
    pairs = spark.createDataFrame([(k, "a", k) for k in ("same", "built", "brighter")], "pair_id string, before_tile_id string, after_tile_id string")
    stats = pixels.pair_statistics(pixels.normalised_after(pixels.pair_pixels(pairs, spark.createDataFrame(rows, SCHEMA))))
    got = {r.pair_id: r for r in pixels.scored_pairs(stats).collect()}
    assert got["same"].score < 0.05 and got["brighter"].score < 0.1
    assert got["built"].score > 0.3 and got["built"].change_type == "construction"
    assert (got["built"].row_min, got["built"].row_max) == (6, 17)


def test_descriptors_and_encoders(spark):
    rows = pixels.descriptors(pixels.with_classes(pixels.with_indices(spark.createDataFrame(scene("a", ""), SCHEMA))))
    desc = dict(zip(pixels.DESCRIPTOR, rows.first().descriptor, strict=True))
    assert desc["veg_frac"] == 1.0 and desc["water_frac"] == 0.0 and desc["ndvi"] > 0.5
    (v,) = encoders.encode_descriptors(rows, dim=32).collect()
    assert math.sqrt(sum(x * x for x in v.vector)) == pytest.approx(1, abs=1e-5)
    water, veg, again = (encoders.encode_text(t) for t in ("river and lake", "dense forest", "river and lake"))
    assert water == again and sum(a * b for a, b in zip(water, encoders.encode_text("water"), strict=True)) > sum(a * b for a, b in zip(water, veg, strict=True))


def test_reviews(spark):
    t = lambda k: dt.datetime(2024, 1, k)
    rows = [("v1", "r1", "q", "accept", "ann", t(1), 0.35, "search_result", None), ("v2", "r1", "q", "reject", "bob", t(2), 0.35, "search_result", None), ("v3", "r2", None, "reject", "ann", t(1), 1.0, "change_analysis", "road")]
    df = spark.createDataFrame(rows, "review_id string, result_id string, query_id string, decision string, analyst_id string, timestamp timestamp, score double, result_type string, change_type string")
    last = review.latest_reviews(df)
    assert sorted(values(last, "result_id", "decision")) == [("r1", "reject"), ("r2", "reject")]
    assert sorted(values(review.calibration(last), "bucket", "reject")) == [("0.3-0.4", 1), ("0.9-1.0", 1)]
    assert values(review.conflicting(df), "result_id") == [("r1",)]
    assert values(review.totals(df), "total_reviews", "reviewed_items", "analysts", "queries_reviewed") == [(3, 2, 2, 1)]
    assert values(review.hard_negatives(last), "result_id") == [("r2",)]
    items = spark.createDataFrame([("r1", "pending_review"), ("r9", "pending_review")], "result_id string, status string")
    assert sorted(values(review.with_status(items, "result_id", df), "result_id", "status")) == [("r1", "rejected"), ("r9", "pending_review")]


def test_truth_matching_and_metrics(spark):
    box = "min_x double, min_y double, max_x double, max_y double"
    d = spark.createDataFrame([(1, 0.9, "a", dt.datetime(2024, 1, 5), 0.0, 0.0, 1.0, 1.0), (2, 0.8, "b", None, 0.5, 0.5, 2.0, 2.0), (3, 0.7, "c", None, 9.0, 9.0, 9.5, 9.5)], f"det_id long, confidence double, change_type string, earliest_supported_time timestamp, {box}")
    t = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1), 0.0, 0.0, 1.0, 1.0), (2, "x", None, 1.5, 1.5, 3.0, 3.0)], f"truth_id long, change_type string, date timestamp, {box}")
    m = evaluation.match_truth(d, t)
    assert sorted(values(m, "det_id", "truth_id")) == [(1, 1), (2, 2)]
    (r,) = evaluation.change_metrics(d, t, m).collect()
    assert (r.tp, r.fp, r.fn, r.type_accuracy, r.median_delay_days) == (2, 1, 0, 0.5, 4)


def test_truth_matching_of_many_in_one_box(spark):
    d = spark.range(700).selectExpr("id as det_id", "(id * 37 % 700) / 700.0D as confidence", "0.0D as min_x", "0.0D as min_y", "1.0D as max_x", "1.0D as max_y")
    t = spark.range(600).selectExpr("id as truth_id", "0.5D as min_x", "0.5D as min_y", "2.0D as max_x", "2.0D as max_y")
    order = sorted(range(700), key=lambda k: -(k * 37 % 700))
    assert dict(values(evaluation.match_truth(d, t), "det_id", "truth_id")) == dict(zip(order, range(600)))  # noqa: B905


def test_truth_matching_against_one_after_another(spark):
    import random

    for seed in range(3):
        r = random.Random(seed)
        box = lambda w: (x := r.randrange(8) * 1.0, y := r.randrange(8) * 1.0, x + w, y + w)
        d = [(k, r.choice([0.2, 0.5, 0.5, 0.9, None]), *box(2.0)) for k in range(300)]
        t = [(k, *box(1.0)) for k in range(200)]
        free, want = dict.fromkeys(range(200)), {}
        for k, _, a, b, c, e in sorted(d, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])):
            first = next((m for m, p, q, u, v in t if m in free and a <= u and c >= p and b <= v and e >= q), None)
            if first is not None:
                want[k] = first
                del free[first]
        sides = "min_x double, min_y double, max_x double, max_y double"
        got = evaluation.match_truth(spark.createDataFrame(d, f"det_id long, confidence double, {sides}"), spark.createDataFrame(t, f"truth_id long, {sides}"), cell=3.0)
        assert sorted(values(got, "det_id", "truth_id")) == sorted(want.items())


def test_clusters(spark):
    rows = [(k, [1.0, 0.01 * k]) for k in range(6)] + [(10 + k, [0.01 * k, 1.0]) for k in range(6)] + [(99, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "tile_id long, vector array<double>")
    got = dict(values(clusters.dbscan_labels(df, 0.05, 4), "tile_id", "cluster_id"))
    assert {got[k] for k in range(6)} == {0} and {got[10 + k] for k in range(6)} == {1} and got[99] == -1
    placed = df.withColumns({"x": F.col("tile_id").cast("double"), "y": F.lit(0.0)})
    assert [r["size"] for r in clusters.discover(placed, "dbscan", eps=0.05, min_cluster_size=4).collect()] == [6, 6]
    assert clusters.discover(placed.limit(3), "dbscan", min_cluster_size=5).count() == 0
    assert sum(r["size"] for r in clusters.discover(placed, "kmeans", n_clusters=3).collect()) == 13


def test_clusters_are_of_all_members(spark):
    many = spark.range(50_100).select(F.col("id").alias("tile_id"), F.array(F.cos("id"), F.sin("id")).alias("vector"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    rows = clusters.discover(many, "kmeans", n_clusters=3).collect()
    assert sum(r["size"] for r in rows) == 50_100 and {(r.total_matching, r.sampled) for r in rows} == {(50_100, False)}
    rows = clusters.discover(many, "kmeans", n_clusters=3, cap=100).collect()
    assert sum(r["size"] for r in rows) == 100 and {(r.total_matching, r.sampled) for r in rows} == {(50_100, True)}
    assert set(values(clusters.bounded_sample(many.limit(20), 20), "total_matching", "sampled")) == {(20, False)}


def test_dbscan_raises_if_labels_still_move(spark):
    chain = spark.range(24).select(F.col("id").alias("tile_id"), F.array(F.cos(F.col("id") / 10), F.sin(F.col("id") / 10)).alias("vector"))
    assert {r.cluster_id for r in clusters.dbscan_labels(chain, 0.006, 2).collect()} == {0}
    with pytest.raises(RuntimeError):
        clusters.dbscan_labels(chain, 0.006, 2, rounds=1)


def test_lineage(spark):
    edges = spark.createDataFrame([("search_result", "r", "tile", "t"), ("tile", "t", "scene", "s"), ("search_result", "r", "search_query", "q")], "child_type string, child_id string, parent_type string, parent_id string")
    up = lineage.ancestors(spark.createDataFrame([("search_result", "r")], "start_type string, start_id string"), edges)
    assert sorted(values(up, "entity_id", "hops")) == [("q", 1), ("r", 0), ("s", 2), ("t", 1)]
    empty = schemas.empty(spark, "provenance_record")
    records = spark.createDataFrame([("tile", "t", dt.datetime(2024, 1, 1), "p1"), ("embedding", "t", dt.datetime(2024, 1, 2), None)], "entity_type string, entity_id string, created_at timestamp, preprocessing_version string")
    full = empty.unionByName(records, allowMissingColumns=True)
    (s,) = lineage.summary(up, full, spark.createDataFrame([("s",)], "scene_id string")).collect()
    assert (s.n_steps, s.n_scenes, s.preprocessing_version, s.complete) == (2, 1, "p1", True)


def test_store_and_stream(spark, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}/store")
    assert store.read("scene").count() == 0
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.tif").write_bytes(b"one")
    (folder / "b.tif").write_bytes(b"one")
    for expected in (1, 1):
        ingest.ingest(ingest.scene_stream(spark, f"file://{folder}"), store, f"file://{tmp_path}/cp").awaitTermination()
        assert store.read("scene").count() == expected
    (folder / "c.tif").write_bytes(b"two")
    ingest.ingest(ingest.scene_stream(spark, f"file://{folder}"), store, f"file://{tmp_path}/cp").awaitTermination()
    assert store.read("scene").count() == 2
    row = store.read("scene").limit(1).withColumn("status", F.lit("failed"))
    store.upsert("scene", row)
    assert sorted(r.status for r in store.read("scene").collect()) == ["complete", "failed"]


def test_files(spark, tmp_path):
    (tmp_path / "S2A_20230110.tif").write_bytes(b"x")
    (tmp_path / "S2A_20230110.json").write_text('{"properties": {"eo:cloud_cover": 12.5, "datetime": "2023-02-01T00:00:00Z"}}')
    (tmp_path / "LC08_20230301.TIF").write_bytes(b"x")
    (tmp_path / "broken.json").write_text("{")
    found = files.discover(spark, [f"file://{tmp_path}"], content=True)
    rows = files.with_metadata(files.with_identity(found).join(files.sidecars(spark, [f"file://{tmp_path}"]), "stem", "left"))
    got = {r.filename: r for r in rows.collect()}
    a, b = got["S2A_20230110.tif"], got["LC08_20230301.TIF"]
    assert (a.platform, a.sensor, a.cloud_percentage, a.acquisition_time) == ("Sentinel-2A", "MSI", 12.5, dt.datetime(2023, 2, 1))
    assert (b.platform, b.sensor, b.acquisition_time) == ("Landsat-8", "OLI", dt.datetime(2023, 3, 1))
    assert a.scene_id == b.scene_id and {a.duplicate, b.duplicate} == {True, False}
    done = found.select("path", "size", "mtime").withColumn("status", F.lit("complete"))
    assert files.not_ingested(found, done).count() == 0
    with pytest.raises(PermissionError):
        files.inside("/data/../etc/x", ["/data"])
    truth = tmp_path / "truth.geojson"
    truth.write_text('{"features": [{"geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,2],[0,0]]]}, "properties": {"change_type": "road", "date": "2023-01-01"}}]}')
    assert values(files.truth_features(spark, f"file://{truth}"), "change_type", "max_y") == [("road", 2.0)]


def test_export_documents(spark):
    df = spark.createDataFrame([("r1", 2, "POLYGON ((0 0, 1 0, 1 1, 0 0))"), ("r2", 1, None)], "result_id string, rank int, geometry string")
    import json

    doc = json.loads(export.feature_collection(df, "result_id", "rank").first().document)
    assert [f["id"] for f in doc["features"]] == ["r2", "r1"] and doc["features"][0]["geometry"] is None
    assert doc["features"][1]["geometry"]["coordinates"][0][1] == [1.0, 0.0] and doc["features"][1]["properties"]["rank"] == 2


def test_deletes_and_registry(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    t = {
        "scene": make([("s1",), ("s2",)], "scene_id string"), "tile": make([("t1", "s1"), ("t2", "s2")], "tile_id string, scene_id string"), "embedding": make([("t1",), ("t2",)], "tile_id string"),
        "temporal_observation": make([("t1",)], "tile_id string"), "search_result": make([("r", "t1")], "result_id string, tile_id string"), "change_evidence": make([("a", "t1", "t2"), ("b", "t2", "t2")], "analysis_id string, before_tile_id string, after_tile_id string"),
    }
    left = tables.delete_scene(t, make([("s1",)], "scene_id string"))
    assert {k: v.count() for k, v in left.items()} == {"scene": 1, "tile": 1, "embedding": 1, "temporal_observation": 0, "search_result": 0, "change_evidence": 1}
    reg = make([("m", "1", "embedding", True), ("c", "1", "change", True)], "model_name string, version string, type string, active boolean")
    out = tables.register_models(reg, make([("m", "2", "embedding", False)], "model_name string, version string, type string, active boolean"))
    assert sorted(values(out, "model_name", "version", "active")) == [("c", "1", True), ("m", "1", False), ("m", "2", True)]
