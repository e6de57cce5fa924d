"""Polygons, hulls, samples and rounding against plain Python."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from orbitframe.functions.numbers import round_half_even
from orbitframe.functions.polygons import polygons_meet
from orbitframe.operators import clusters, evaluation


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def brute_hull(points):
    """By definition: the points from which some line leaves all others on one side, those within edges left out."""
    points = sorted(set(points))
    if len(points) < 3:
        return set(points)
    edges = [(a, b) for a in points for b in points if a != b and all(turn(a, b, c) >= 0 for c in points)]
    between = lambda p: any(turn(a, b, p) == 0 and p not in (a, b) and min(a, b) < p < max(a, b) for a, b in edges)
    return {p for e in edges for p in e if not between(p)}


def test_hulls_against_brute_force(spark):
    rng = random.Random(1)
    groups = {g: [(Fraction(rng.randint(0, 6 + g)), Fraction(rng.randint(0, 6))) for _ in range(rng.randint(1, 40))] for g in range(25)}
    groups |= {100: [(Fraction(i), Fraction(2 * i)) for i in range(9)], 101: [(Fraction(3), Fraction(3))] * 5, 102: [(Fraction(0), Fraction(0)), (Fraction(1), Fraction(1))]}
    rows = [(g, float(x), float(y)) for g, ps in groups.items() for x, y in ps] + [(1, None, 2.0), (1, math.nan, 2.0), (103, None, None)]
    got = {}
    for r in clusters.convex_hulls(spark.createDataFrame(rows, "g long, x double, y double").repartition(5), "g").orderBy("g", "place").collect():
        got.setdefault(r.g, []).append((Fraction(r.x), Fraction(r.y)))
    assert {g: set(ps) for g, ps in got.items()} == {g: brute_hull(ps) for g, ps in groups.items()}
    for ps in got.values():
        assert ps[0] == min(ps) and len(ps) == len(set(ps))
        assert len(ps) < 3 or all(turn(ps[i - 2], ps[i - 1], ps[i]) > 0 for i in range(len(ps)))


def test_hulls_of_near_lines_are_exact(spark):
    """Points that doubles can't tell from a line, and a round group of many corners."""
    near = [(0.1 * k, 0.3 * k) for k in range(40)]
    ring = [(math.cos(k / 500 * math.pi), math.sin(k / 500 * math.pi)) for k in range(1000)]
    df = spark.createDataFrame([("near", *p) for p in near] + [("ring", *p) for p in ring] * 3, "g string, x double, y double")
    rows = clusters.convex_hulls(df, "g").collect()
    exact = {(float(x), float(y)) for x, y in brute_hull([(Fraction(x), Fraction(y)) for x, y in near])}
    assert {(r.x, r.y) for r in rows if r.g == "near"} == exact
    assert sum(r.g == "ring" for r in rows) == 1000


def inside(p, rings):
    """Winding by angles, for points off the edges."""
    total = 0.0
    for ring in rings:
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            total += math.atan2((a[0] - p[0]) * (b[1] - p[1]) - (a[1] - p[1]) * (b[0] - p[0]), (a[0] - p[0]) * (b[0] - p[0]) + (a[1] - p[1]) * (b[1] - p[1]))
    return abs(total) > 1


def segments_meet(a, b, c, d):
    on = lambda p, q, r: turn(p, q, r) == 0 and min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
        return True
    return on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b)


def test_polygons_against_brute_force(spark):
    shapes = [[(0, 0), (4, 0), (0, 4)], [(2, 0), (4, 2), (2, 4), (0, 2)], [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], [(0, 0), (4, 2), (0, 4), (1, 2)], [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]
    rng = random.Random(2)
    made = lambda: [(x * s + dx, y * s + dy) for s, dx, dy in [(rng.randint(1, 3), rng.randint(0, 9), rng.randint(0, 9))] for x, y in rng.choice(shapes)]
    pairs = [([made()], [made()]) for _ in range(400)]
    # a frame with a hole, and something in the hole, across it, and around all
    frame = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (2, 8), (8, 8), (8, 2)]]
    pairs += [(frame, [[(4, 4), (5, 4), (5, 5)]]), (frame, [[(1, 1), (5, 4), (5, 5)]]), (frame, [[(-5, -5), (20, -5), (20, 20), (-5, 20)]])]
    rows = [(k, [[list(map(float, p)) for p in r] for r in a], [[list(map(float, p)) for p in r] for r in b]) for k, (a, b) in enumerate(pairs)]
    kind = "array<array<array<double>>>"
    got = {r.k: r.m for r in spark.createDataFrame(rows, f"k long, a {kind}, b {kind}").select("k", polygons_meet(F.col("a"), F.col("b")).alias("m")).collect()}
    edges = lambda rings: [(p, q) for r in rings for p, q in zip(r, r[1:] + r[:1], strict=True)]
    for k, (a, b) in enumerate(pairs[:400]):
        assert got[k] == (any(segments_meet(*e, *f) for e in edges(a) for f in edges(b)) or inside(a[0][0], b) or inside(b[0][0], a)), k
    assert [got[400], got[401], got[402]] == [False, True, True]
    assert 50 < sum(got.values()) < 350


def test_truth_is_matched_by_polygons(spark):
    """An L whose box holds a square that its area doesn't."""
    kind = "array<array<array<double>>>"
    ell, square = [[[0.0, 0.0], [4.0, 0.0], [4.0, 1.0], [1.0, 1.0], [1.0, 4.0], [0.0, 4.0]]], [[[2.0, 2.0], [3.0, 2.0], [3.0, 3.0], [2.0, 3.0]]]
    d = spark.createDataFrame([(1, 0.9, 0.0, 0.0, 4.0, 4.0, ell), (2, 0.8, 2.0, 2.0, 3.0, 3.0, square)], f"det_id long, confidence double, min_x double, min_y double, max_x double, max_y double, rings {kind}")
    t = spark.createDataFrame([(7, 2.0, 2.0, 3.0, 3.0, square)], f"truth_id long, min_x double, min_y double, max_x double, max_y double, rings {kind}")
    assert [tuple(r) for r in evaluation.match_truth(d, t).collect()] == [(2, 7)]
    assert [tuple(r) for r in evaluation.match_truth(d.drop("rings"), t).collect()] == [(1, 7)]


def test_sample_is_the_same_at_any_number_of_partitions(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("t"), "id").alias("tile_id"), (F.col("id") % 3 % 2).alias("stratum"))
    picks = [{r.tile_id for r in clusters.bottom_k(rows.repartition(n), 700, seed=4).collect()} for n in (1, 3, 16)]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 700
    other = {r.tile_id for r in clusters.bottom_k(rows, 700, seed=5).collect()}
    assert len(other & picks[0]) < 100
    by = clusters.bounded_sample(rows, 6000, by="stratum").groupBy("stratum").agg(F.count("*").alias("n"), F.countDistinct("tile_id").alias("d"), F.max("total_matching").alias("t"), F.max("sampled").alias("s"))
    assert {r.stratum: (r.n, r.d, r.t, r.s) for r in by.collect()} == {0: (6000, 6000, 13_333, True), 1: (6000, 6000, 6667, True)}
    # each row is in with the same chance: the share in ten ranges of ids is near a tenth
    ranges = clusters.bottom_k(rows, 5000).groupBy((F.substring("tile_id", 2, 9).cast("int") / 2000).cast("int").alias("range")).count().collect()
    assert len(ranges) == 10 and all(420 < r["count"] < 580 for r in ranges)
    assert clusters.bottom_k(rows.limit(0), 5).collect() == []
    assert clusters.bottom_k(rows.limit(5), 5).count() == 5 and clusters.bottom_k(rows.limit(5), 0).count() == 0


@pytest.mark.parametrize("digits", [0, 1, 2, 4, 6])
def test_rounding_is_exact(spark, digits):
    """Ties, near-ties and others, as Python's round has them."""
    rng = random.Random(digits)
    values = [0.0, -0.0, 0.5, 1.5, 2.5, -0.5, -1.5, 2.675, 1.005, 1e300, -1e300, 5e-324, 2.0**52 + 1, 2.0**53, 0.1 + 0.2, 4503599627370495.5]
    for _ in range(20_000):
        tie = (2 * rng.randint(-(10**rng.randint(1, 9)), 10 ** rng.randint(1, 9)) + 1) / 2 / 10**digits
        values += [tie, math.nextafter(tie, math.inf), math.nextafter(tie, -math.inf)]
        values += [rng.randint(-4000, 4000) / 2 ** rng.randint(1, 12), rng.uniform(-1, 1) * 10 ** rng.randint(-8, 14)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_half_even(F.col("v"), digits).alias("r")).collect()
    wrong = [(r.v, r.r, round(r.v, digits)) for r in rows if r.r != round(r.v, digits) or math.copysign(1, r.r) != math.copysign(1, round(r.v, digits))]
    assert not wrong, wrong[:5]


def test_rounding_keeps_what_isnt_a_number(spark):
    rows = spark.createDataFrame([(None,), (math.nan,), (math.inf,)], "v double").select(round_half_even(F.col("v"), 2).alias("r")).collect()
    assert rows[0].r is None and math.isnan(rows[1].r) and rows[2].r == math.inf


def test_equal_shapes_are_looked_at_once(spark, monkeypatch):
    """Two shapes on either side, many rows of each, and rows that are equal as a whole: pairs of rows come from pairs of shapes."""
    looked = spark.sparkContext.accumulator(0)
    look = F.udf(lambda: looked.add(1) or True, "boolean").asNondeterministic()
    monkeypatch.setattr(evaluation, "edges_meet", lambda a, b, real=evaluation.edges_meet: real(a, b) & look())
    monkeypatch.setattr(evaluation, "SHAPE_ROWS", 8, raising=False)
    kind = "array<array<array<double>>>"
    ell, square, hook = [[[0.0, 0.0], [4.0, 0.0], [4.0, 1.0], [1.0, 1.0], [1.0, 4.0], [0.0, 4.0]]], [[[2.0, 2.0], [3.0, 2.0], [3.0, 3.0], [2.0, 3.0]]], [[[0.5, 0.5], [3.5, 3.5], [0.5, 3.5]]]
    left = [(k // 2, k % 2 / 2, 0.0, 0.0, 4.0, 4.0, ell) if k % 3 else (k // 2, 0.5, 2.0, 2.0, 3.0, 3.0, square) for k in range(60)] + [(99, 0.5, None, None, None, None, None)]
    right = [(k, 2.0, 2.0, 3.0, 3.0, square) if k % 2 else (k, 0.5, 0.5, 3.5, 3.5, hook) for k in range(30)]
    box = "min_x double, min_y double, max_x double, max_y double"
    met = evaluation.meeting(spark.createDataFrame(left, f"id long, confidence double, {box}, rings {kind}"), spark.createDataFrame(right, f"id long, {box}, rings {kind}"))
    assert met.columns == ["l_id", "l_confidence", *[f"l_{c}" for c in (*evaluation.BOX, "rings")], "r_id", *[f"r_{c}" for c in (*evaluation.BOX, "rings")]]
    got = sorted((r.l_id, r.l_confidence, r.l_max_x, r.r_id, r.r_min_x, len(r.r_rings[0])) for r in met.collect())
    assert got == sorted((a[0], a[1], a[4], b[0], b[1], len(b[5][0])) for a in left[:60] for b in right if not (a[6] is ell and b[5] is square))
    assert 0 < looked.value <= 4
