"""Queries of temporal change, tile quality and pair scores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import export, pixels, temporal
from ..session import shared_folder
from ..streaming import change as stream
from . import proxies as P
from .registry import register

SERIES = f"""{P.OBSERVATIONS},
good AS (SELECT *, row_number() OVER (PARTITION BY location_key ORDER BY acquisition_time NULLS FIRST, tile_id) - 1 AS seq,
                count(*) OVER (PARTITION BY location_key) AS n FROM observations WHERE usable AND quality_score >= 0.3),
refs AS (SELECT location_key, seq AS ref_seq, tile_id AS ref_tile_id, quality_score AS ref_quality, acquisition_time AS ref_time FROM (
           SELECT *, row_number() OVER (PARTITION BY location_key ORDER BY quality_score DESC, seq) AS r FROM good WHERE seq < greatest(1, n // 3)) WHERE r = 1),
later AS (SELECT g.*, r.ref_seq, r.ref_tile_id, r.ref_quality, r.ref_time, count(*) OVER (PARTITION BY g.location_key) AS m, g.seq - r.ref_seq - 1 AS nth
          FROM good g JOIN refs r USING (location_key) WHERE g.n >= 2 AND g.seq > r.ref_seq),
pairs AS (SELECT *, row_number() OVER (PARTITION BY location_key ORDER BY seq) - 1 AS pair FROM later
          WHERE m <= 6 OR nth IN (0, round_even((m - 1) / 5.0, 0), round_even(2 * (m - 1) / 5.0, 0), round_even(3 * (m - 1) / 5.0, 0), round_even(4 * (m - 1) / 5.0, 0), m - 1))"""

CONSENSUS = f"""{SERIES},
flagged AS (SELECT *, score >= 0.15 AS flag, avg(CASE WHEN score >= 0.15 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY location_key ORDER BY pair ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM pairs),
onsets AS (SELECT location_key, coalesce(min(pair) FILTER (flag AND ahead >= 0.5), min(pair) FILTER (flag)) AS onset FROM flagged GROUP BY location_key),
after AS (SELECT f.*, o.onset FROM flagged f JOIN onsets o USING (location_key) WHERE o.onset IS NOT NULL AND f.pair >= o.onset),
votes AS (SELECT location_key, change_type, sum(score * coalesce(nullif(quality_score, 0), 0.5)) AS v, min(pair) AS since FROM after WHERE flag GROUP BY location_key, change_type),
typed AS (SELECT location_key, arg_max(change_type, v - since * 1e-13) AS change_type, max(v) / greatest(sum(v), 1e-9) AS agreement FROM votes GROUP BY location_key),
stats AS (SELECT location_key, count(*) AS n_after, count(*) FILTER (flag) AS n_support, least(quantile_cont(score, 0.5) FILTER (flag), 1.0) AS base_score,
                 avg(quality_score) FILTER (flag) AS support_quality, max(ref_quality) AS ref_quality, min(tile_id) FILTER (pair = onset) AS earliest_tile_id FROM after GROUP BY location_key),
joined AS (SELECT *, n_support / n_after AS persistence, least(greatest(0.5 * ref_quality + 0.5 * support_quality, 0), 1) AS qf,
                  CASE WHEN n_support = 1 THEN n_after > 1 ELSE n_support / n_after < 0.5 END AS transient FROM stats JOIN typed USING (location_key)),
final AS (SELECT *, least(greatest(base_score * qf * persistence * least(1.0, 0.55 + 0.15 * n_support) * CASE WHEN n_support = 1 THEN 0.5 + 0.5 * support_quality ELSE 1 END
                  * CASE WHEN transient THEN 0.5 ELSE 1 END * (0.7 + 0.3 * agreement), 0), 1) AS confidence FROM joined)"""


def _six(column: str):
    """A number from 0 on to six decimals as SQL rounds it: its product with a million, half away from zero."""
    return (F.round(F.col(column) * 1e6) / 1e6).alias(column)


def _consensus(spark, sf_dir):
    return temporal.consensus(temporal.pairs(P.observations(spark, sf_dir), min_quality=0.3))


@register("change_pairs", f"WITH {SERIES} SELECT location_key, ref_tile_id, tile_id, CAST(pair AS INT) AS pair FROM pairs")
def change_pairs(spark, sf_dir):
    return temporal.pairs(P.observations(spark, sf_dir), min_quality=0.3).select("location_key", "ref_tile_id", "tile_id", "pair")


@register("change_consensus", f"WITH {CONSENSUS} SELECT location_key, change_type, earliest_tile_id, CAST(n_support AS BIGINT) AS n_support, CAST(n_after AS BIGINT) AS n_after, transient, round(persistence, 6) AS persistence, round(agreement, 6) AS agreement, round(confidence, 6) AS confidence FROM final")
def change_consensus(spark, sf_dir):
    out = _consensus(spark, sf_dir)
    return out.select("location_key", "change_type", "earliest_tile_id", "n_support", "n_after", "transient", *map(_six, ("persistence", "agreement", "confidence")))


@register("change_onsets", f"""WITH {CONSENSUS},
seen AS (SELECT location_key, pair, tile_id, acquisition_time, ref_tile_id, ref_time, lag(tile_id) OVER w AS prev, lag(acquisition_time) OVER w AS prev_time FROM pairs WINDOW w AS (PARTITION BY location_key ORDER BY pair))
SELECT s.location_key, s.tile_id AS earliest_tile_id, s.acquisition_time AS earliest_supported_time, coalesce(prev, ref_tile_id) AS last_unchanged_tile_id, coalesce(prev_time, ref_time) AS last_unchanged_time FROM seen s JOIN onsets o ON o.location_key = s.location_key AND o.onset = s.pair""")
def change_onsets(spark, sf_dir):
    out = _consensus(spark, sf_dir)
    return out.select("location_key", "earliest_tile_id", F.col("earliest_supported_time").cast("timestamp_ntz").alias("earliest_supported_time"), "last_unchanged_tile_id", F.col("last_unchanged_time").cast("timestamp_ntz").alias("last_unchanged_time"))


@register("change_evidence", f"WITH {SERIES} SELECT location_key AS analysis_id, tile_id AS after_tile_id, CAST(row_number() OVER (PARTITION BY location_key ORDER BY acquisition_time NULLS FIRST, tile_id) AS INT) AS place FROM pairs")
def change_evidence(spark, sf_dir):
    pairs = temporal.pairs(P.observations(spark, sf_dir), min_quality=0.3)
    evidence = pairs.select(F.col("location_key").alias("analysis_id"), F.col("tile_id").alias("after_tile_id"), F.col("acquisition_time").alias("after_time"))
    return export.evidence_by_time(evidence).select("analysis_id", "after_tile_id", "place")


@register("change_stream", f"WITH {CONSENSUS} SELECT location_key, change_type, CAST(n_support AS BIGINT) AS n_support, CAST(n_after AS BIGINT) AS n_after, round(confidence, 6) AS confidence FROM final")
def change_stream(spark, sf_dir):
    """The same changes from the events read as a stream, with each location's observations as state."""
    events = P.observations_of(spark.readStream.schema(P.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*"))  # a pattern, as the source takes a file by a pattern only
    folder = f"{shared_folder(spark)}/change-stream-{uuid.uuid4().hex}"
    stream.start(events, f"{folder}/results", f"{folder}/checkpoint", min_quality=0.3, delay="3650 days").awaitTermination()
    return stream.current(spark, f"{folder}/results").select("location_key", "change_type", "n_support", "n_after", _six("confidence"))


@register("change_reported", f"WITH {CONSENSUS} SELECT location_key, change_type, round(confidence, 6) AS confidence FROM final WHERE confidence >= 0.2 AND change_type <> 'none'")
def change_reported(spark, sf_dir):
    return temporal.reported(_consensus(spark, sf_dir)).select("location_key", "change_type", _six("confidence"))


@register("change_diagnostics", f"""WITH {SERIES}
SELECT CAST(count(*) AS BIGINT) AS observations, CAST(count(DISTINCT location_key) AS BIGINT) AS locations, CAST(count(*) FILTER (NOT (usable AND quality_score >= 0.3)) AS BIGINT) AS dropped_low_quality,
       CAST((SELECT count(*) FROM (SELECT location_key FROM observations GROUP BY location_key HAVING count(*) FILTER (usable AND quality_score >= 0.3) < 2)) AS BIGINT) AS locations_insufficient,
       CAST((SELECT count(*) FROM pairs) AS BIGINT) AS pairs_evaluated FROM observations""")  # fmt: skip
def change_diagnostics(spark, sf_dir):
    return temporal.diagnostics(P.observations(spark, sf_dir), min_quality=0.3)


@register("search_verified_change", f"""WITH {CONSENSUS},
ranks AS (SELECT event_id, user_id, ts, (0.5 * 0.45 + least(value / 100, 1.0) * 0.15 + 0.5 * 0.1) / (0.45 + 0.15 + 0.1) AS prelim FROM events),
firsts AS (SELECT user_id, arg_max(event_id, (prelim, -event_id)) AS event_id, max(prelim) AS prelim FROM ranks GROUP BY user_id),
budget AS (SELECT user_id FROM firsts ORDER BY prelim DESC, event_id LIMIT 50)
SELECT t.event_id AS tile_id, f.location_key, f.change_type, round(f.confidence, 6) AS change FROM final f JOIN budget b ON b.user_id = f.location_key JOIN events t ON t.user_id = f.location_key
JOIN events o ON o.event_id = f.earliest_tile_id WHERE f.confidence >= 0.2 AND f.change_type <> 'none' AND t.ts >= o.ts""")
def search_verified_change(spark, sf_dir):
    """Verified change at the 50 best locations, as many as a search may look at."""
    from ..operators.search import verified

    tiles = P.tiles(spark, sf_dir).withColumns({"semantic": F.lit(0.5), "quality": F.col("quality_score"), "metadata": F.lit(0.5)})
    out = verified(tiles, temporal.reported(_consensus(spark, sf_dir)), ["semantic", "quality", "metadata"])
    return out.select("tile_id", "location_key", "change_type", F.round("change", 6).alias("change"))


CLASSES = f"""{P.PIXELS},
ix AS (SELECT *, (nir - red) / (nir + red + 1e-6) AS ndvi, (green - nir) / (green + nir + 1e-6) AS ndwi, (red + green + blue) / 3 AS bright, greatest(red, green, blue) AS peak FROM pixels),
w AS (SELECT *, sqrt((pow(red - bright, 2) + pow(green - bright, 2) + pow(blue - bright, 2)) / 3) / (bright + 1e-6) AS white FROM ix),
s AS (SELECT *, valid AND bright > 0.45 AND ndwi > 0.2 AND blue >= red AND nir < bright AS snow FROM w),
c AS (SELECT *, valid AND NOT snow AND bright > 0.75 * 0.6 AND white < 0.12 AND (bright > 0.75 OR nir > 0.5) AS cloud FROM s),
k AS (SELECT *, valid AND NOT cloud AND NOT snow AND blue > 0.2 AND blue > 1.25 * red AND white < 0.25 AS haze, valid AND NOT cloud AND bright < 0.08 AND ndwi < 0.1 AND nir < 0.12 AS shadow, valid AND peak >= 0.999 AS sat FROM c)"""


@register("tile_quality", f"""WITH {CLASSES},
a AS (SELECT tile_id, count(*) AS n, count(*) FILTER (valid) AS v, count(*) FILTER (cloud) AS cl, count(*) FILTER (haze) AS hz, count(*) FILTER (snow) AS sn, count(*) FILTER (shadow) AS sh, count(*) FILTER (sat) AS st,
             count(*) FILTER (valid AND NOT cloud AND NOT haze AND NOT snow AND NOT shadow AND NOT sat) AS cr, quantile_cont(bright, 0.98) FILTER (valid) AS p98, quantile_cont(bright, 0.02) FILTER (valid) AS p02 FROM k GROUP BY tile_id),
q AS (SELECT tile_id, least(1.0, cl / v * 1.15) AS c, hz / v AS h, sn / v AS s, sh / v AS d, v / n AS vr, cr / n AS clear, least(greatest(1 - 2 * st / v, 0), 1) * least(greatest((p98 - p02) / 0.01, 0.5), 1.0) AS r FROM a),
o AS (SELECT *, least(greatest(vr * (1 - c) * (1 - 0.6 * h) * (1 - 0.5 * s) * (1 - 0.5 * d) * r, 0), 1) AS overall FROM q)
SELECT tile_id, round(c, 6) AS cloud_score, round(vr, 6) AS valid_pixel_ratio, round(clear, 6) AS clear_ratio, round(overall, 6) AS overall_quality, overall >= 0.5 AND vr >= 0.2 AND clear >= 0.2 AS usable_for_change_detection FROM o""")  # fmt: skip
def tile_quality(spark, sf_dir):
    out = pixels.tile_quality(pixels.with_classes(pixels.with_indices(P.pixels(spark, sf_dir))))
    return out.select("tile_id", *[F.round(c, 6).alias(c) for c in ("cloud_score", "valid_pixel_ratio", "clear_ratio", "overall_quality")], "usable_for_change_detection")


@register("tile_entropy", f"""WITH {CLASSES}, h AS (SELECT tile_id, least(floor(bright * 32), 31) AS bin, count(*) AS c FROM k WHERE valid AND bright BETWEEN 0 AND 1 GROUP BY tile_id, bin),
p AS (SELECT tile_id, c / sum(c) OVER (PARTITION BY tile_id) AS p FROM h) SELECT tile_id, round(-sum(p * log2(p)) / 5, 6) AS texture FROM p GROUP BY tile_id""")
def tile_entropy(spark, sf_dir):
    rows = pixels.with_indices(P.pixels(spark, sf_dir))
    return pixels.entropy(rows, F.col("valid")).select("tile_id", F.round("texture", 6).alias("texture"))


@register("pair_typing", """WITH s AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS pair_id, l_quantity / 100 AS share, l_discount * 10 AS strength, l_discount - 0.05 AS dv, 0.04 - l_tax AS dw, l_tax - 0.03 AS db, (l_discount - 0.06) / 4 AS de, l_tax * 2 AS w1, l_discount AS u0, l_quantity / 50 AS u1 FROM lineitem),
t AS (SELECT *, CASE WHEN share > 0.002 THEN least(sqrt(share / 0.25) * (0.6 + 0.4 * strength), 1.0) ELSE 0 END AS raw,
  4 * abs(w1 - 0.1) + 1.5 * abs(dw) AS a, 1.2 * greatest(-dv, 0) + 12 * greatest(de, 0) + 4 * greatest(u1 - u0, 0) AS b, greatest(2 * greatest(-dv, 0) + greatest(db, 0) - 6 * greatest(de, 0), 0) AS c, 1.5 * greatest(u1 - u0, 0) AS d,
  2 * greatest(db, 0) + 5 * greatest(de, 0) AS e, 2 * greatest(-db, 0) + 5 * greatest(-de, 0) AS f, 3 * greatest(u1 - u0, 0) AS g, 3 * greatest(u0 - u1, 0) AS h FROM s),
m AS (SELECT *, greatest(a, b, c, d, e, f, g, h) AS top FROM t)
SELECT pair_id, round(raw, 6) AS raw_score, CASE WHEN raw = 0 OR top < 0.1 THEN 'unknown' WHEN a = top THEN 'water_extent_change' WHEN b = top THEN 'construction' WHEN c = top THEN 'clearance' WHEN d = top THEN 'road_development'
  WHEN e = top THEN 'appearance' WHEN f = top THEN 'disappearance' WHEN g = top THEN 'expansion' ELSE 'contraction' END AS change_type FROM m""")  # fmt: skip
def pair_typing(spark, sf_dir):
    r = P.table(spark, sf_dir, "lineitem")
    lit = lambda v: F.lit(float(v))
    stats = r.select(
        F.expr(P.RESULT_ID).alias("pair_id"), F.lit(10000).alias("n_pixels"), F.lit(10000).alias("n_common"), (F.col("l_quantity") * 100).alias("n_changed"), (F.col("l_discount") * 10).alias("strength"),
        (F.col("l_discount") - 0.05).alias("d_ndvi"), (0.04 - F.col("l_tax")).alias("d_ndwi"), (F.col("l_tax") - 0.03).alias("d_brightness"), ((F.col("l_discount") - 0.06) / 4).alias("d_edge"),
        lit(0.1).alias("water_before"), (F.col("l_tax") * 2).alias("water_after"), F.col("l_discount").alias("built_before"), (F.col("l_quantity") / 50).alias("built_after"), lit(0).alias("veg_before"),
        lit(0).alias("ndvi_spread"), lit(0).alias("ndvi_shift"), lit(0.2).alias("median_before"), lit(0.2).alias("median_after"),
    )
    return pixels.scored_pairs(stats).select("pair_id", F.round("raw_score", 6).alias("raw_score"), "change_type")


@register("change_export_rows", f"""WITH {CONSENSUS}
SELECT f.location_key AS analysis_id, f.change_type, p.ref_tile_id AS before_tile, p.tile_id AS after_tile, round(p.score, 6) AS evidence_score, '/api/v1/provenance/change_analysis/' || f.location_key AS provenance_href FROM final f JOIN pairs p USING (location_key)""")
def change_export_rows(spark, sf_dir):
    pairs = temporal.pairs(P.observations(spark, sf_dir), min_quality=0.3)
    found = temporal.consensus(pairs).select(F.col("location_key").alias("analysis_id"), "change_type", "confidence", "earliest_supported_time", F.lit("m").alias("model_name"), F.lit("1").alias("model_version"))
    evidence = pairs.select(F.col("location_key").alias("analysis_id"), F.col("ref_tile_id").alias("before_tile_id"), F.col("tile_id").alias("after_tile_id"), F.col("ref_time").alias("before_time"), F.col("acquisition_time").alias("after_time"), F.col("score").alias("evidence_score"))
    tiles = P.tiles(spark, sf_dir).select("tile_id", F.col("location_key").alias("scene_id"))
    scenes = tiles.select("scene_id").distinct().withColumns({"source_path": F.col("scene_id").cast("string"), "checksum": F.sha2(F.col("scene_id").cast("string"), 256)})
    rows = export.change_rows(found, evidence, tiles, scenes)
    return rows.select("analysis_id", "change_type", "before_tile", "after_tile", F.round("evidence_score", 6).alias("evidence_score"), "provenance_href")
