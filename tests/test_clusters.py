"""Clusters without tables of pairs: reductions by block against brute force, in both ways that vectors meet."""

import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import clusters

#: (dimensions, distance, neighbours): in few dimensions pivots save pairs, in many all blocks meet.
CASES = {"pivots": (3, 0.004, 4), "blocks": (24, 0.45, 4)}


def made(name):
    dims, eps, least = CASES[name]
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(700, dims))
    vectors[600:660] = vectors[:60] + rng.normal(0, 0.01, (60, dims))
    vectors[660:] = vectors[5]  # copies
    vectors[699] = 0
    unit = np.array([v / max(np.linalg.norm(v), 1e-12) for v in vectors])
    return vectors, 1 - unit @ unit.T, eps, least


def table(spark, vectors, text):
    name = (lambda k: f"t{k:04d}") if text else (lambda k: k)
    rows = [(name(k), v.tolist()) for k, v in enumerate(vectors)] + [(name(9000), None)]
    return spark.createDataFrame(rows, f"tile_id {'string' if text else 'long'}, vector array<double>").repartition(5)


def joined(n, edges):
    """The least member of each one's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for e in edges:
        a, b = find(e[0]), find(e[1])
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(e)
    return [find(k) for k in range(n)], kept


def reachable(far, eps, least):
    """Edges of mutual reachability in the order of weight and ends."""
    core = {k: sorted(row[row <= eps])[least - 1] for k, row in enumerate(far) if (row <= eps).sum() >= least}
    near = [(a, b) for a in core for b in core if a < b and far[a, b] <= eps]
    return sorted((max(far[a, b], core[a], core[b]), a, b) for a, b in near)


@pytest.fixture(params=list(CASES))
def case(request, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 40)
    return request.param


def test_case_is_what_it_says(spark, case):
    assert (clusters.RadiusJoin(table(spark, made(case)[0], False), CASES[case][1]).plan is None) == (case == "blocks")


@pytest.mark.parametrize("text", [False, True])
def test_dbscan_against_brute_force(spark, case, text):
    vectors, far, eps, least = made(case)
    near = far <= eps
    core = near.sum(1) >= least
    root, _ = joined(len(far), [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if core[a] and core[b]])
    ids = {r: k for k, r in enumerate(sorted({root[k] for k in np.flatnonzero(core)}))}
    want = [(ids[min(root[b] for b in np.flatnonzero(near[a] & core))] if (near[a] & core).any() else -1, bool(core[a])) for a in range(len(far))]
    rows = clusters.dbscan_labels(table(spark, vectors, text), eps, least).collect()
    got = {int(str(r.tile_id).lstrip("t") or 0): (r.cluster_id, r.is_core) for r in rows}
    assert len(rows) == len(far) + 1 and got.pop(9000) == (-1, False)
    assert [got[k] for k in range(len(far))] == want and len(ids) > 3 and (-1, False) in want


@pytest.mark.parametrize("by_rounds", [False, True])
def test_forest_and_levels_against_brute_force(spark, case, monkeypatch, by_rounds):
    if by_rounds:
        monkeypatch.setattr(clusters, "LAST_EDGES", 30)
    vectors, far, eps, least = made(case)
    edges = reachable(far, eps, least)
    _, want = joined(len(far), [(a, b, w) for w, a, b in edges])
    df = table(spark, vectors, False)
    got = clusters.spanning_forest(clusters.reachability_edges(df, eps, least)).collect()
    assert np.allclose(sorted(r.weight for r in got), sorted(w for _, _, w in want), atol=1e-9) and len(want) > 100
    assert joined(len(far), [(r.a, r.b) for r in got])[0] == joined(len(far), want)[0]
    levels = [eps * 0.8, eps]
    expected, wider = set(), None
    for level in reversed(levels):
        inside = [(a, b) for w, a, b in edges if w <= level]
        root, _ = joined(len(far), inside)
        for r in set(root):
            if root.count(r) >= 3:
                expected.add((level, r, root.count(r), None if wider is None else wider[r]))
        wider = root
    assert {(r.level, r.root, r.size, r.parent) for r in clusters.density_levels(df, levels, least, 3).collect()} == expected and len(expected) > 4


def test_counts_are_those_of_the_pairs(spark, case):
    vectors, far, eps, _ = made(case)
    got = {r.a: r.n for r in clusters.neighbour_counts(table(spark, vectors, False), eps).collect()}
    assert got == {k: n for k, n in enumerate((far <= eps).sum(1).tolist()) if n}
    pairs = {(r.a, r.b): r.distance for r in clusters.neighbours(table(spark, vectors, False), eps, True).collect()}
    assert set(pairs) == set(zip(*(x.tolist() for x in np.nonzero(far <= eps)), strict=True)) and all(pairs[b, a] == d for (a, b), d in pairs.items())


def test_plan_of_many_dimensions_takes_little_memory():
    """The driver's part for 4096 vectors that visit every cell."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4096, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    tracemalloc.start()
    pairs, _ = clusters.PivotPlan(v[:256], 1.3**0.5).work(v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs > 0.9 and peak < 150e6


def test_levels_take_few_jobs(spark):
    """What the driver keeps grows with the jobs."""
    rng = np.random.default_rng(2)
    df = table(spark, rng.normal(size=(1500, 8)), False).filter("vector is not null")
    spark.sparkContext.setJobGroup("levels", "levels")
    clusters.density_levels(df, [0.05, 0.1, 0.2], 2, 3).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("levels")) < 80


def test_blocks_that_all_meet_are_not_copied(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 40)
    work = clusters.join_work(table(spark, made("blocks")[0], False).filter("vector is not null"), 0.45).first()
    assert work.n == 700 and work.pairs == 700 * 700 and work.copies == 700


def test_links_are_few_where_pairs_are_many(spark):
    """DBSCAN's links of one group of copies: about as many as members, not as their pairs."""
    df = spark.range(3000).select(F.col("id").alias("tile_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    join = clusters.RadiusJoin(df, 0.1)
    links = join.run(lambda: clusters.Links(0.1), "a long, b long, border boolean", join.unit.withColumn("core", F.lit(True)))
    assert 2999 <= links.count() < 3000 * 2 * 8
    assert clusters.label_counts(clusters.dbscan_labels(df, 0.1, 4)).first()[:] == (3000, 1, 3000, 0)


def test_summaries_of_a_large_group_of_copies(spark, tmp_path):
    """The tables that DBSCAN leaves in the shared folder grow with members and not with their pairs (9 000 000 here, some 100 MB)."""
    rows = spark.range(3000).select(F.col("id").alias("tile_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    taken = lambda: sum(f.stat().st_size for f in Path(folder.removeprefix("file:")).resolve().rglob("part-*"))
    before = taken()
    assert [(r["size"], r.total_matching) for r in clusters.discover(rows, "dbscan", eps=0.1, min_cluster_size=4).collect()] == [(3000, 3000)]
    assert taken() - before < 20e6


def test_noise_against_brute_force(spark, case):
    vectors, far, eps, least = made(case)
    core = (far <= eps).sum(1) >= least
    held = (far <= eps)[:, core].any(1)
    row = clusters.label_counts(clusters.dbscan_labels(table(spark, vectors, False), eps, least)).first()
    assert (row.members, row.noise, row.cores) == (701, int((~held).sum()) + 1, int(core.sum())) and row.noise > 5
