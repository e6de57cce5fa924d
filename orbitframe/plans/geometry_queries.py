"""Queries of polygons, hulls, samples and rounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import round_half_even
from ..functions.polygons import bounds
from ..operators import clusters, evaluation
from . import proxies as P
from .registry import register

#: Corners of the shapes that keys choose from: a triangle, a diamond, an L and an arrow head; the last two are concave.
SHAPES = [[(0, 0), (4, 0), (0, 4)], [(2, 0), (4, 2), (2, 4), (0, 2)], [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], [(0, 0), (4, 2), (0, 4), (1, 2)]]


def _shapes(rows, key: str, name: str):
    """``rows`` as (name, confidence, rings, box): a shape, its size and place by the key."""
    k = F.col(key)
    corners = F.get(F.array(*[F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in s]) for s in SHAPES]), (k % 4).cast("int"))
    at = lambda p: F.array(k * 7 % 90 + p[0] * (1 + k % 3), k * 11 % 60 + p[1] * (1 + k % 3))
    out = rows.select(k.alias(name), (k * 37 % 101).alias("confidence"), F.array(F.transform(corners, at)).alias("rings"))
    return out.withColumn("b", bounds(F.col("rings"))).select(name, "confidence", "rings", "b.*")


_VALUES = ", ".join(f"({s}, {i}, {len(c)}, {x}, {y})" for s, c in enumerate(SHAPES) for i, (x, y) in enumerate(c))
EDGES = f"""shape(kind, i, n, dx, dy) AS (VALUES {_VALUES}),
pts AS (SELECT side, id, i, n, id * 7 % 90 + dx * (1 + id % 3) AS x, id * 11 % 60 + dy * (1 + id % 3) AS y
  FROM (SELECT 'd' AS side, c_custkey AS id FROM customer UNION ALL SELECT 't', s_suppkey FROM supplier) JOIN shape ON kind = id % 4),
e AS (SELECT a.side, a.id, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM pts a JOIN pts b ON a.side = b.side AND a.id = b.id AND b.i = (a.i + 1) % a.n)"""


def _side(e: str, x: str, y: str) -> str:
    return f"sign(({e}.bx - {e}.ax) * ({y} - {e}.ay) - ({e}.by - {e}.ay) * ({x} - {e}.ax))"


_CROSS = " AND ".join(
    [f"least(d.{a}, d.{b}) <= greatest(t.{a}, t.{b}) AND least(t.{a}, t.{b}) <= greatest(d.{a}, d.{b})" for a, b in (("ax", "bx"), ("ay", "by"))]
    + [f"{_side(g, h + '.ax', h + '.ay')} * {_side(g, h + '.bx', h + '.by')} <= 0" for g, h in (("t", "d"), ("d", "t"))]
)
_WITHIN = "(e.ay > p.y) <> (e.by > p.y) AND p.x < (e.bx - e.ax) * (p.y - e.ay) / CAST(nullif(e.by - e.ay, 0) AS DOUBLE) + e.ax"
PAIRS = f"""{EDGES},
crossing AS (SELECT DISTINCT d.id AS d, t.id AS t FROM e d JOIN e t ON d.side = 'd' AND t.side = 't' AND {_CROSS}),
within AS (SELECT p.side, p.id, e.id AS other FROM pts p JOIN e ON e.side <> p.side AND p.i = 0 AND {_WITHIN} GROUP BY p.side, p.id, e.id HAVING count(*) % 2 = 1),
met AS (SELECT d, t FROM crossing UNION SELECT CASE side WHEN 'd' THEN id ELSE other END, CASE side WHEN 'd' THEN other ELSE id END FROM within)"""


@register("truth_polygon_pairs", f"WITH {PAIRS} SELECT d AS det_id, t AS truth_id FROM met")
def truth_polygon_pairs(spark, sf_dir):
    """Which detections meet which truths, as polygons of four shapes."""
    d, t = _shapes(P.table(spark, sf_dir, "customer"), "c_custkey", "det_id"), _shapes(P.table(spark, sf_dir, "supplier"), "s_suppkey", "truth_id")
    return evaluation.meeting(d.drop("confidence"), t.drop("confidence"), cell=8.0).select(F.col("l_det_id").alias("det_id"), F.col("r_truth_id").alias("truth_id"))


@register("cluster_hulls", """WITH RECURSIVE p AS (SELECT DISTINCT c_nationkey AS nation, CAST(round(c_acctbal * 100) AS BIGINT) AS x, c_custkey % 997 AS y FROM customer),
start AS (SELECT nation, min((x, y)) AS s, count(*) AS n FROM p GROUP BY nation),
walk AS (SELECT nation, 0 AS place, s[1] AS x, s[2] AS y, s[1] AS sx, s[2] AS sy, n FROM start
  UNION ALL SELECT nation, place + 1, best[1], best[2], sx, sy, n FROM (
    SELECT w.nation, w.place, w.sx, w.sy, w.n, (SELECT max_by((a.x, a.y), (a.x - w.x) * (a.x - w.x) + (a.y - w.y) * (a.y - w.y)) FROM p a WHERE a.nation = w.nation AND (a.x, a.y) <> (w.x, w.y)
      AND NOT EXISTS (SELECT 1 FROM p b WHERE b.nation = w.nation AND (a.x - w.x) * (b.y - w.y) - (a.y - w.y) * (b.x - w.x) < 0)) AS best FROM walk w) WHERE best IS NOT NULL AND (best[1] <> sx OR best[2] <> sy))
SELECT CAST(nation AS INT) AS nation, CAST(place AS INT) AS place, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM walk""")
def cluster_hulls(spark, sf_dir):
    points = P.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("int").alias("nation"), F.round(F.col("c_acctbal") * 100).cast("double").alias("x"), (F.col("c_custkey") % 997).cast("double").alias("y"))
    return clusters.convex_hulls(points, "nation")


@register("stratified_sample", "SELECT o_orderpriority AS stratum, CAST(least(count(*), 200) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS total_matching, count(*) > 200 AS sampled FROM orders GROUP BY o_orderpriority")
def stratified_sample(spark, sf_dir):
    """At most 200 orders of each priority."""
    rows = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tile_id"), F.col("o_orderpriority").alias("stratum"))
    return clusters.bounded_sample(rows, 200, by="stratum").groupBy("stratum").agg(F.countDistinct("tile_id").alias("n"), F.max("total_matching").alias("total_matching"), F.max("sampled").alias("sampled"))


@register("rounded_ties", """WITH k AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey * 8 + l_linenumber AS BIGINT) * 125 AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(t // 10 + CASE WHEN t % 10 > 5 OR (t % 10 = 5 AND (t // 10) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100 AS rounded FROM k""")
def rounded_ties(spark, sf_dir):
    """Eighths to two decimals: a quarter of them are ties."""
    rows = P.table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", round_half_even((F.col("l_partkey") * 8 + F.col("l_linenumber")) / 8.0, 2).alias("rounded"))
