"""Queries of search, filters and scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import spatial
from ..functions.vectors import dot, literal, norm, normalised
from ..operators import batch_search, export, search, tables
from ..operators.encoders import encode_text
from ..operators.filters import TileFilter, with_tile_counts
from . import proxies as P
from .registry import register

BBOX = [-150.0, -60.0, 120.0, 70.0]
START = dt.datetime(2024, 1, 1, 4)
WHERE = dict(bbox=BBOX, date_from=START, min_quality=0.05, max_cloud=95.0)
PASSES = """max_x >= -150.0 AND min_x <= 120.0 AND max_y >= -60.0 AND min_y <= 70.0
         AND acquisition_time >= TIMESTAMP '2024-01-01 04:00:00' AND quality_score >= 0.05 AND cloud_percentage <= 95.0"""

POOL = f"""{P.TILES},
q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
hits AS (
  SELECT t.*, e.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])) AS sim
  FROM tiles t JOIN embeddings e ON e.vec_id = t.tile_id CROSS JOIN q WHERE {PASSES}),
pool AS (SELECT * FROM hits ORDER BY sim DESC, vec_id LIMIT 60),
parts AS (
  SELECT *, greatest(least(sim, 1.0), 0.0) AS semantic, quality_score AS quality,
         (greatest(least(1 - cloud_percentage / 100, 1.0), 0.0) + greatest(least(valid_pixel_percentage / 100, 1.0), 0.0)) / 2 AS metadata,
         greatest(0.0, least(max_x, 120.0) - greatest(min_x, -150.0)) * greatest(0.0, least(max_y, 70.0) - greatest(min_y, -60.0)) / ((max_x - min_x) * (max_y - min_y)) AS spatial,
         cume_dist() OVER (ORDER BY acquisition_time) AS temporal
  FROM pool),
ranked AS (SELECT *, (semantic * 0.45 + quality * 0.15 + metadata * 0.1 + spatial * 0.1) / (0.45 + 0.15 + 0.1 + 0.1) AS final_score FROM parts)"""


def _first_vector(spark, sf_dir):
    """The query: one stored vector, as a constant."""
    return literal(P.embeddings(spark, sf_dir).filter("tile_id = 0").select("vector").head().vector)


def _search(spark, sf_dir, **where):
    params = search.SearchParams(top_k=20, where=TileFilter(**where), temporal_intent=True)
    return search.search(P.tiles(spark, sf_dir), P.embeddings(spark, sf_dir), _first_vector(spark, sf_dir), params)


@register("search_filtered_ranked", f"""WITH {POOL},
best AS (SELECT *, row_number() OVER (PARTITION BY location_key ORDER BY final_score DESC, tile_id) AS b FROM ranked),
top AS (SELECT * FROM best WHERE b = 1 ORDER BY final_score DESC, tile_id LIMIT 20)
SELECT CAST(row_number() OVER (ORDER BY final_score DESC, tile_id) AS INT) AS rank, tile_id, location_key, round(semantic, 6) AS semantic,
       round(temporal, 6) AS temporal, round(final_score, 6) AS final_score, round(0.5 * final_score + 0.5 * least(semantic, quality), 6) AS confidence
FROM top""")  # fmt: skip
def search_filtered_ranked(spark, sf_dir):
    out = _search(spark, sf_dir, **WHERE)
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("rank", "tile_id", "location_key", r("semantic"), r("temporal"), r("final_score"), r("confidence"))


@register("search_components", f"""WITH {POOL}
SELECT tile_id, round(sim, 6) AS sim, round(metadata, 6) AS metadata, round(spatial, 6) AS spatial, round(temporal, 6) AS temporal FROM ranked""")
def search_components(spark, sf_dir):
    """Over a table with the vectors of two models and of texts, of which one model's image vectors are searched."""
    params = search.SearchParams(top_k=20, where=TileFilter(**WHERE), model=("m", "2"))
    vectors = P.embeddings(spark, sf_dir).withColumn("model_name", F.lit("m"))
    negative = F.transform("vector", lambda x: -x)
    both = vectors.withColumns({"model_version": F.lit("2"), "type": F.lit("image")})
    both = both.unionByName(vectors.withColumns({"model_version": F.lit("1"), "type": F.lit("image"), "vector": negative})).unionByName(vectors.withColumns({"model_version": F.lit("2"), "type": F.lit("text"), "vector": negative}))
    pool = search.similar(P.tiles(spark, sf_dir), both, _first_vector(spark, sf_dir), 60, params.where, params.model)
    rows, _ = search.components(pool, params)
    return rows.select("tile_id", *[F.round(c, 6).alias(c) for c in ("sim", "metadata", "spatial", "temporal")])


@register("search_similar_sites", f"""WITH {P.TILES},
q AS (SELECT embedding AS v, user_id AS loc FROM embeddings JOIN events ON vec_id = event_id WHERE vec_id = 7),
hits AS (SELECT t.tile_id, t.quality_score, t.location_key, t.cloud_percentage, t.valid_pixel_percentage,
                list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])) AS sim
         FROM tiles t JOIN embeddings e ON e.vec_id = t.tile_id CROSS JOIN q WHERE t.location_key <> q.loc),
pool AS (SELECT *, greatest(least(sim, 1.0), 0.0) AS semantic, ((1 - cloud_percentage / 100) + valid_pixel_percentage / 100) / 2 AS metadata
         FROM (SELECT * FROM hits ORDER BY sim DESC, tile_id LIMIT 30)),
ranked AS (SELECT *, (semantic * 0.45 + quality_score * 0.15 + metadata * 0.1) / (0.45 + 0.15 + 0.1) AS f FROM pool),
best AS (SELECT *, row_number() OVER (PARTITION BY location_key ORDER BY f DESC, tile_id) AS b FROM ranked)
SELECT tile_id, round(f, 6) AS final_score FROM best WHERE b = 1 ORDER BY f DESC, tile_id LIMIT 10""")  # fmt: skip
def search_similar_sites(spark, sf_dir):
    out = search.similar_to_tile(P.tiles(spark, sf_dir), P.embeddings(spark, sf_dir), 7, search.SearchParams(top_k=10))
    return out.select("tile_id", F.round("final_score", 6).alias("final_score"))


@register("search_export_features", f"""WITH {P.TILES}
SELECT tile_id, '{{"type":"Polygon","coordinates":[[[' || max_x || ',' || min_y || '],[' || max_x || ',' || max_y || '],[' || min_x || ',' || max_y || '],[' || min_x || ',' || min_y || '],[' || max_x || ',' || min_y || ']]]}}' AS geometry,
       round(greatest(0.0, least(max_x, 120.0) - greatest(min_x, -150.0)) * greatest(0.0, least(max_y, 70.0) - greatest(min_y, -60.0)) / 100, 6) AS inside
FROM tiles WHERE {PASSES}""")  # fmt: skip
def search_export_features(spark, sf_dir):
    rows = TileFilter(**WHERE).apply(P.tiles(spark, sf_dir))
    return rows.select("tile_id", spatial.geojson(spatial.wkt_box(*spatial.box_columns())).alias("geometry"), F.round(spatial.covered_fraction(BBOX), 6).alias("inside"))


@register("search_export_documents")
def search_export_documents(spark, sf_dir):
    """A feature of every tile that passes, its columns as properties."""
    rows = TileFilter(**WHERE).apply(P.tiles(spark, sf_dir)).withColumn("geometry", spatial.wkt_box(*spatial.box_columns()))
    return export.features(rows, "tile_id")


@register("filter_tile_counts", f"WITH {P.TILES} SELECT sensor, CAST(count(*) AS BIGINT) AS n, round(avg(quality_score), 6) AS quality FROM tiles WHERE {PASSES} AND lower(platform) <> 'none' GROUP BY sensor")
def filter_tile_counts(spark, sf_dir):
    return TileFilter(**WHERE).apply(P.tiles(spark, sf_dir)).groupBy("sensor").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("quality"))


@register("scene_tile_counts", "SELECT c_custkey AS scene_id, CAST(count(o_orderkey) AS BIGINT) AS tile_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def scene_tile_counts(spark, sf_dir):
    scenes = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scene_id"))
    return with_tile_counts(scenes, P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scene_id")))


@register("scene_quality", "SELECT o_custkey AS scene_id, round(coalesce(avg(o_totalprice / 7), 0), 3) AS quality_score, round(avg(o_totalprice / 11), 3) AS cloud_percentage, CAST(count(*) AS BIGINT) AS tile_count FROM orders GROUP BY o_custkey")
def scene_quality(spark, sf_dir):
    tiles = P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scene_id"), (F.col("o_totalprice") / 7).alias("quality_score"), (F.col("o_totalprice") / 11).alias("cloud_percentage"))
    out = tables.scene_quality(tiles)
    return out.select("scene_id", F.round("quality_score", 3).alias("quality_score"), F.round("cloud_percentage", 3).alias("cloud_percentage"), "tile_count")


@register("reject_penalties", f"""WITH {P.REVIEWS} SELECT result_id AS tile_id, CAST(count(*) AS BIGINT) AS rejects, round(least(0.9, 0.05 * count(*)), 6) AS penalty FROM reviews WHERE decision = 'reject' GROUP BY result_id""")
def reject_penalties(spark, sf_dir):
    from ..functions.scores import reject_penalty

    r = P.reviews(spark, sf_dir)
    results = r.select("result_id").distinct().withColumn("tile_id", F.col("result_id"))
    return search.reject_counts(results, r).withColumn("penalty", F.round(reject_penalty(F.col("rejects"), 0.05), 6))


@register("vector_norms", """SELECT vec_id AS tile_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12), 6) AS self_cosine FROM embeddings""")
def vector_norms(spark, sf_dir):
    rows = P.embeddings(spark, sf_dir)
    return rows.select("tile_id", F.round(norm(F.col("vector")), 6).alias("norm"), F.round(dot(normalised(F.col("vector")), F.col("vector")), 6).alias("self_cosine"))


@register("embedding_counts", "SELECT CAST(label AS INT) AS label, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY label")
def embedding_counts(spark, sf_dir):
    return P.embeddings(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@register("index_new_vectors", "SELECT CAST(count(*) FILTER (vec_id % 3 <> 0) AS BIGINT) AS added, CAST(max(vec_id) FILTER (vec_id % 3 = 0) + 1 AS BIGINT) AS first_id, CAST(max(vec_id) FILTER (vec_id % 3 = 0) + count(*) FILTER (vec_id % 3 <> 0) AS BIGINT) AS last_id, CAST(count(*) FILTER (vec_id % 3 <> 0) AS BIGINT) AS distinct_ids FROM embeddings")
def index_new_vectors(spark, sf_dir):
    rows = P.embeddings(spark, sf_dir)
    held = rows.filter("tile_id % 3 = 0").withColumns({"model_name": F.lit("m"), "model_version": F.lit("1")})
    new = tables.new_vectors(rows.select("tile_id", "vector"), held, "m", "1")
    return new.agg(F.count("*").alias("added"), F.min("vector_id").alias("first_id"), F.max("vector_id").alias("last_id"), F.countDistinct("vector_id").alias("distinct_ids"))


@register("index_reconcile", """SELECT CAST(count(*) FILTER (e.event_id IS NULL) AS BIGINT) AS to_restore, CAST(count(*) FILTER (v.vec_id IS NULL) AS BIGINT) AS orphans, CAST(count(v.vec_id) AS BIGINT) AS n_table, CAST(count(e.event_id) AS BIGINT) AS n_index
FROM embeddings v FULL JOIN (SELECT event_id FROM events WHERE event_id % 7 <> 0) e ON v.vec_id = e.event_id""")
def index_reconcile(spark, sf_dir):
    index = P.table(spark, sf_dir, "events").filter("event_id % 7 <> 0").select(F.col("event_id").alias("vector_id"))
    return tables.reconcile(P.embeddings(spark, sf_dir), index)


@register("registry_register", """SELECT model_name, version, type, CASE WHEN new THEN TRUE WHEN type IN (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 5 = 0) THEN FALSE ELSE p_size > 25 END AS active
FROM (SELECT p_name || '-' || p_partkey AS model_name, CAST(p_size AS VARCHAR) AS version, p_brand AS type, p_size, p_partkey % 5 = 0 AS new FROM part)""")
def registry_register(spark, sf_dir):
    part = P.table(spark, sf_dir, "part")
    rows = part.select(F.concat_ws("-", "p_name", "p_partkey").alias("model_name"), F.col("p_size").cast("string").alias("version"), F.col("p_brand").alias("type"), (F.col("p_size") > 25).alias("active"), "p_partkey")
    held = rows.filter("p_partkey % 5 <> 0 or p_partkey % 10 = 0").drop("p_partkey")
    return tables.register_models(held, rows.filter("p_partkey % 5 = 0").drop("p_partkey"))


@register("grid_cells", """WITH b AS (SELECT c_custkey, c_acctbal * 10 AS x0, c_acctbal * 7 AS y0 FROM customer),
c AS (SELECT c_custkey, CAST(floor(x0 / 2560) AS BIGINT) AS gx0, CAST(ceil((x0 + 5000) / 2560) - 1 AS BIGINT) AS gx1, CAST(floor(y0 / 2560) AS BIGINT) AS gy0, CAST(ceil((y0 + 3000) / 2560) - 1 AS BIGINT) AS gy1 FROM b),
g AS (SELECT c_custkey, gx, unnest(generate_series(gy0, gy1)) AS gy FROM (SELECT *, unnest(generate_series(gx0, gx1)) AS gx FROM c))
SELECT c_custkey, '32643:10:256:' || gx || ':' || gy AS location_key FROM g""")
def grid_cells(spark, sf_dir):
    b = P.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * 10).alias("x"), (F.col("c_acctbal") * 7).alias("y"))
    cells = b.select("c_custkey", F.explode(spatial.grid_cells(F.col("x"), F.col("y"), F.col("x") + 5000, F.col("y") + 3000, F.lit(10.0), 256)).alias("g"))
    return cells.select("c_custkey", spatial.location_key(spatial.crs_key(F.lit(32643), F.lit("")), F.lit(10.0), F.lit(256), F.col("g.gx"), F.col("g.gy")).alias("location_key"))


@register("footprints_to_wgs84", """SELECT c_custkey, round(degrees(c_acctbal * 1000 / 6378137.0), 6) AS lon, round(degrees(2 * atan(exp(c_acctbal * 500 / 6378137.0)) - pi() / 2), 6) AS lat FROM customer""")
def footprints_to_wgs84(spark, sf_dir):
    rows = P.table(spark, sf_dir, "customer").select("c_custkey", spatial.to_wgs84(F.lit(3857), F.col("c_acctbal") * 1000, F.col("c_acctbal") * 500).alias("p"))
    return rows.select("c_custkey", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


#: The parts that the texts of suppliers' queries are composed of, and what the concepts and contexts are called.
ASKED_FOR = [("buildings", "built structures"), ("water", "water"), ("forest", "vegetation"), ("road", "road"), ("desert", "bare soil"), ("snow", "snow"), ("ships", "vessel")]
PLACES = [("", ""), (" near a river", " near river"), (" along the coast", " along coast")]
DIM = 64


def _composed(spark, sf_dir):
    """Suppliers as queries: a text of parts chosen by their keys, and for some of them a date, a box, a quality or a sensor."""
    pick = lambda values, key: F.get(F.array(*map(F.lit, values)), key.cast("int"))
    k, some = F.col("s_suppkey"), lambda when, value: F.when(when, F.lit(value))
    text = F.concat(F.when(k % 5 == 0, F.lit("new ")).otherwise(""), pick([a for a, _ in ASKED_FOR], k % 7), pick([a for a, _ in PLACES], k % 3), F.when(k % 4 == 0, F.lit(" since 2024")).otherwise(""))
    return P.table(spark, sf_dir, "supplier").select(
        k.alias("query_id"), text.alias("text"), F.when(k % 2 == 0, F.timestamp_add("DAY", (k % 20).cast("int"), F.lit(dt.datetime(2024, 1, 1)))).alias("date_from"), F.when(k % 5 < 3, (k % 5) / 20.0).alias("min_quality"),
        F.when(k % 11 == 0, F.lit("CLICK")).alias("sensor"), *[some(k % 3 == 0, v).alias(f"q_{c}") for c, v in zip(spatial.BOX, BBOX, strict=True)],
    )


def _vectors() -> str:
    # a place adds nothing to a concept that it belongs to
    rows = [(i, j, encode_text(concept if concept == "water" else concept + place, DIM)) for i, (_, concept) in enumerate(ASKED_FOR) for j, (_, place) in enumerate(PLACES)]
    return ", ".join(f"({i}, {j}, CAST({v!r} AS DOUBLE[]))" for i, j, v in rows)


@register("search_text_batch", f"""WITH {P.TILES},
v(i, j, vec) AS (VALUES {_vectors()}),
q AS (SELECT s_suppkey AS query_id, vec, s_suppkey % 5 = 0 OR s_suppkey % 2 = 0 AS dated, s_suppkey % 11 = 0 AS sensed, s_suppkey % 3 = 0 AS boxed,
    CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(s_suppkey % 20 AS INT) END AS date_from, CASE WHEN s_suppkey % 5 < 3 THEN (s_suppkey % 5) / 20.0 END AS least
  FROM supplier JOIN v ON s_suppkey % 7 = i AND s_suppkey % 3 = j),
hits AS (SELECT q.*, t.*, e.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), q.vec) AS sim FROM q JOIN tiles t
    ON (q.date_from IS NULL OR acquisition_time >= q.date_from) AND (least IS NULL OR quality_score >= least) AND (NOT sensed OR lower(sensor) = 'click')
    AND (NOT boxed OR (max_x >= -150.0 AND min_x <= 120.0 AND max_y >= -60.0 AND min_y <= 70.0)) JOIN embeddings e ON e.vec_id = t.tile_id),
pool AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 30),
parts AS (SELECT *, greatest(least(sim, 1.0), 0.0) AS semantic, quality_score AS quality,
    (CASE WHEN sensed THEN 1.0 ELSE 0.0 END + greatest(least(1 - cloud_percentage / 100, 1.0), 0.0) + greatest(least(valid_pixel_percentage / 100, 1.0), 0.0)) / CASE WHEN sensed THEN 3 ELSE 2 END AS metadata,
    greatest(0.0, least(max_x, 120.0) - greatest(min_x, -150.0)) * greatest(0.0, least(max_y, 70.0) - greatest(min_y, -60.0)) / ((max_x - min_x) * (max_y - min_y)) AS spatial FROM pool),
ranked AS (SELECT *, (semantic * 0.45 + quality * 0.15 + metadata * 0.1 + CASE WHEN boxed THEN spatial * 0.1 ELSE 0 END) / (0.7 + CASE WHEN boxed THEN 0.1 ELSE 0 END) AS final_score FROM parts),
best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id, location_key ORDER BY final_score DESC, tile_id) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, tile_id) AS rank FROM best)
SELECT query_id, CAST(rank AS INT) AS rank, tile_id, location_key, round(semantic, 6) AS semantic, round(final_score, 6) AS final_score, round(0.5 * final_score + 0.5 * least(semantic, quality), 6) AS confidence FROM top WHERE rank <= 10""")  # fmt: skip
def search_text_batch(spark, sf_dir):
    """From the text of every query to its ranked tiles."""
    out = batch_search.search_texts(_composed(spark, sf_dir), P.tiles(spark, sf_dir), P.embeddings(spark, sf_dir), 10, dim=DIM)
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("query_id", "rank", "tile_id", "location_key", r("semantic"), r("final_score"), r("confidence"))


def _utm_sql() -> str:
    """UTM metres to degrees by the series of the inverse projection, as SQL steps."""
    a, e2, k0 = spatial.A, spatial.E2, spatial.K0
    e1, ep = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5), e2 / (1 - e2)
    arc = a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    return f"""m AS (SELECT *, CASE WHEN north THEN y ELSE y - 1e7 END / {k0} / {arc!r} AS mu FROM b),
p AS (SELECT *, mu + {3 * e1 / 2 - 27 * e1**3 / 32!r} * sin(2 * mu) + {21 * e1**2 / 16 - 55 * e1**4 / 32!r} * sin(4 * mu) + {151 * e1**3 / 96!r} * sin(6 * mu) AS p FROM m),
w AS (SELECT *, pow(tan(p), 2) AS t, {ep!r} * cos(p) * cos(p) AS g, {a} / sqrt(1 - {e2} * sin(p) * sin(p)) AS n, {a * (1 - e2)!r} / pow(1 - {e2} * sin(p) * sin(p), 1.5) AS r FROM p),
d AS (SELECT *, (x - 5e5) / (n * {k0}) AS d FROM w)
SELECT c_custkey, round(degrees((d - (1 + 2 * t + g) * pow(d, 3) / 6 + (5 - 2 * g + 28 * t - 3 * g * g + {8 * ep!r} + 24 * t * t) * pow(d, 5) / 120) / cos(p)) + zone * 6 - 183, 6) AS lon,
  round(degrees(p - n * tan(p) / r * (d * d / 2 - (5 + 3 * t + 10 * g - 4 * g * g - {9 * ep!r}) * pow(d, 4) / 24)), 6) AS lat FROM d"""


@register("footprints_from_utm", f"WITH b AS (SELECT c_custkey, 500000 + CAST(c_acctbal AS DOUBLE) * 20 AS x, 4000000 + CAST(c_custkey % 1000 AS DOUBLE) * 1000 AS y, CAST(1 + c_custkey % 60 AS DOUBLE) AS zone, c_custkey % 2 = 0 AS north FROM customer), {_utm_sql()}")
def footprints_from_utm(spark, sf_dir):
    """Points of all UTM zones, of both hemispheres."""
    k = F.col("c_custkey")
    epsg = (F.when(k % 2 == 0, 32600).otherwise(32700) + 1 + k % 60).cast("int")
    rows = P.table(spark, sf_dir, "customer").select("c_custkey", spatial.to_wgs84(epsg, 500000 + F.col("c_acctbal").cast("double") * 20, 4000000 + (k % 1000).cast("double") * 1000).alias("p"))
    return rows.select("c_custkey", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))
