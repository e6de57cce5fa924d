"""Shift search, alignment, and the radius join, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import clusters, registration

PIXELS = "pair_id string, row int, col int, b_brightness double, a_brightness double, common boolean"


def rows_of(name, before, after, common):
    h, w = before.shape
    return [(name, r, c, float(before[r, c]), float(after[r, c]), bool(common[r, c])) for r in range(h) for c in range(w)]


def test_planted_shifts_are_found(spark):
    rng = np.random.default_rng(1)
    rows, planted = [], {"a": (2, -3), "b": (0, 0), "c": (-5, 6), "d": (0, 7), "far": (0, 11)}
    for name, (dy, dx) in planted.items():
        image = rng.random((20, 26))
        common = rng.random((20, 26)) > 0.2
        # rolled by the shift, the after image is the before image again, but for some noise
        rows += rows_of(name, image, np.roll(image, (-dy, -dx), (0, 1)) + rng.normal(0, 0.01, image.shape), common)
    rows += rows_of("other", rng.random((12, 12)), rng.random((12, 12)), np.ones((12, 12), bool))
    df = spark.createDataFrame(rows, PIXELS)
    got = {r.pair_id: r for r in registration.best_shifts(df).collect()}
    assert {n: (r.dy, r.dx) for n, r in got.items()} == {**planted, "far": (0, 0), "other": (0, 0)}
    assert got["a"].registration == pytest.approx(1 - 0.03 * math.hypot(2, 3)) and got["b"].registration == got["far"].registration == 1.0
    assert got["c"].registration == pytest.approx(max(0.7, 1 - 0.03 * math.hypot(5, 6)))
    moved = registration.with_shift(df, registration.best_shifts(df)).filter("pair_id = 'c'").agg(F.max(F.abs(F.col("a_brightness") - F.col("b_brightness")))).first()[0]
    assert moved < 0.1


def test_residuals_with_missing_pixels(spark):
    rng = np.random.default_rng(2)
    before, after, common, there = rng.random((6, 7)), rng.random((6, 7)), rng.random((6, 7)) > 0.3, rng.random((6, 7)) > 0.2
    there[5, 6] = True
    rows = [r for r in rows_of("p", before, after, common) if there[r[1], r[2]]]
    got = {(r.dy, r.dx): r.residual for r in registration.shift_residuals(spark.createDataFrame(rows, PIXELS), 2).collect()}
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            gaps = [abs(after[(r - dy) % 6, (c - dx) % 7] - before[r, c]) for r in range(6) for c in range(7) if there[r, c] and common[r, c] and there[(r - dy) % 6, (c - dx) % 7]]
            assert got[dy, dx] == pytest.approx(np.mean(gaps))


def test_alignment_against_plain_bilinear(spark):
    rng = np.random.default_rng(3)
    image, valid = rng.random((9, 8)), rng.random((9, 8)) > 0.15
    pixels = spark.createDataFrame([("t", r, c, float(image[r, c]), bool(valid[r, c])) for r in range(9) for c in range(8)], "tile_id string, row int, col int, blue double, valid boolean")
    source, target = (10.0, 0.0, 100.0, 0.0, -10.0, 500.0), (6.0, 2.0, 95.0, -2.0, -6.0, 490.0)
    kind = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
    grids = spark.createDataFrame([("t", source, target, 9, 8, 12, 13)], f"tile_id string, source {kind}, target {kind}, source_height int, source_width int, height int, width int")
    got = {(r.row, r.col): (r.blue, r.valid) for r in registration.aligned(pixels, grids, ("blue",), fill=-1.0).collect()}
    inverse = np.linalg.inv([[source[0], source[1]], [source[3], source[4]]])
    filled = 0
    for r in range(12):
        for c in range(13):
            x = np.array([target[0] * (c + 0.5) + target[1] * (r + 0.5) + target[2] - source[2], target[3] * (c + 0.5) + target[4] * (r + 0.5) + target[5] - source[5]])
            u, v = inverse @ x - 0.5
            total = weight = 0.0
            if -0.5 <= u < 7.5 and -0.5 <= v < 8.5:
                i, j = math.floor(v), math.floor(u)
                for a, wa in ((i, 1 - (v - i)), (i + 1, v - i)):
                    for b, wb in ((j, 1 - (u - j)), (j + 1, u - j)):
                        if 0 <= a < 9 and 0 <= b < 8 and valid[a, b] and wa * wb > 0:
                            total, weight = total + wa * wb * image[a, b], weight + wa * wb
            assert got[r, c] == ((pytest.approx(total / weight), True) if weight else (-1.0, False))
            filled += not weight
    assert 0 < filled < 156


def brute_near(vectors, eps):
    unit = np.array([v / max(np.linalg.norm(v), 1e-12) for v in vectors])
    return {(int(a), int(b)) for a, b in zip(*np.nonzero(1 - unit @ unit.T <= eps), strict=True)}


@pytest.mark.parametrize("eps", [0.002, 0.15, 1.2])
def test_radius_join_against_brute_force(spark, monkeypatch, eps):
    """Clusters in few dimensions, repeated vectors, a zero vector; whatever the number of pivots and the size of blocks."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 4))
    vectors = np.concatenate([centres[rng.integers(0, 12, 500)] + rng.normal(0, 0.05, (500, 4)), rng.normal(size=(60, 4)), np.zeros((1, 4)), np.tile(centres[:1], (40, 1))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "tile_id long, vector array<double>").repartition(3)
    monkeypatch.setattr(clusters, "BLOCK", 64)
    got = [(r.a, r.b) for r in clusters.neighbours(df, eps).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(vectors, eps)
    work = clusters.join_work(df, eps).first()
    assert work.n == len(vectors) and work.pairs >= len(got) - 1
    if eps < 0.1:
        assert work.pairs < work.n**2 / 4
    assert clusters.neighbours(df.limit(0), eps).collect() == []


def test_pivots_keep_every_pair(spark):
    """With any pivots, who is within the radius of a vector visits its home."""
    rng = np.random.default_rng(5)
    for dims, radius in ((2, 0.3), (6, 0.7), (16, 1.0)):
        v = rng.normal(size=(150, dims))
        v /= np.linalg.norm(v, axis=1)[:, None]
        plan = clusters.PivotPlan(v[:10], radius)
        home, ring, who, cell, at = plan.places(v)
        visits = set(zip(who.tolist(), cell.tolist(), at.tolist(), strict=True))
        for a, b in zip(*np.nonzero(np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)) <= radius), strict=True):
            assert (a, home[b], ring[b]) in visits


def test_numbers_in_order(spark):
    ids = random.Random(1).sample(range(10_000), 300)
    rows = clusters.numbered(spark.createDataFrame([(i,) for i in ids], "root long").repartition(4), "root", "n").collect()
    assert {r.root: r.n for r in rows} == {i: k for k, i in enumerate(sorted(ids))}
