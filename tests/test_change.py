"""Change consensus: equal votes and sums of doubles."""

import datetime as dt
import random

import pytest
from compare import connect, rows_of

from orbitframe.operators import temporal
from orbitframe.plans import all_queries, registry  # noqa: F401

SCORED = "location_key long, pair int, tile_id long, acquisition_time timestamp, quality_score double, score double, change_type string, registration double, ref_tile_id long, ref_time timestamp, ref_quality double"
DAY0 = dt.datetime(2024, 1, 1)


def scored(spark, series):
    """``series``: location to its pairs' (quality, score, type)."""
    rows = [(loc, k, k, DAY0, q, s, kind, 1.0, 99, DAY0, 0.9) for loc, pairs in series.items() for k, (q, s, kind) in enumerate(pairs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCORED).repartition(7)


def test_equal_votes_go_to_the_earliest_type(spark):
    """Three tenths in one and in three parts, whose doubles differ; a missing type isn't chosen."""
    series = {1: [(0.5, 0.6, "b"), *[(0.5, 0.2, "a")] * 3], 2: [*[(0.5, 0.2, "a")] * 3, (0.5, 0.6, "b")], 3: [(0.5, 0.9, None), (0.5, 0.2, "a")]}
    got = {r.location_key: (r.change_type, round(r.agreement, 9)) for r in temporal.consensus(scored(spark, series)).collect()}
    assert got == {1: ("b", 0.5), 2: ("a", 0.5), 3: ("a", round(0.9 / 1.1, 9))}


def test_confidence_is_the_same_double_in_any_order_of_rows(spark):
    rng = random.Random(3)
    series = {loc: [(round(rng.uniform(0.3, 1), 4), rng.randint(15, 99) / 100, "a") for _ in range(rng.randint(1, 6))] for loc in range(400)}
    want = {}
    for loc, pairs in series.items():
        n, scores = len(pairs), sorted(s for _, s, _ in pairs)
        support = 0.0
        for q, _, _ in pairs:
            support += q
        support /= n
        low, high = scores[(n - 1) // 2], scores[n // 2]
        base, quality = low + (high - low) * 0.5, 0.5 * 0.9 + 0.5 * support
        want[loc] = base * quality * 1.0 * min(1.0, (55 + 15 * n) / 100) * (0.5 + 0.5 * support if n == 1 else 1.0) * (0.7 + 0.3 * 1.0)
    assert {r.location_key: r.confidence for r in temporal.consensus(scored(spark, series)).collect()} == want


@pytest.fixture(scope="module")
def coarse(spark, tmp_path_factory):
    """Events with coarse scores and qualities, so that many votes and products tie; at one location three votes of 0.24 tie with one of 0.72."""
    rng, folder = random.Random(5), tmp_path_factory.mktemp("coarse")
    made = [(rng.choice(["view", "click", "none"]), rng.choice([40, 50, 60, 80, 100]), rng.choice([20, 30, 40, 60])) for _ in range(700 * 5)]
    made[:3500:700] = [("view", 100, 90), *[("view", 80, 30)] * 3, ("click", 80, 90)]
    rows = [(k, DAY0 + dt.timedelta(hours=k), k % 700, kind, float(value), f'{{"k": {score}}}') for k, (kind, value, score) in enumerate(made)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/made")
    (part,) = (folder / "made").glob("*.parquet")
    (folder / "events.parquet").symlink_to(part)
    return str(folder)


@pytest.mark.parametrize("name", ["change_consensus", "change_reported", "change_stream"])
def test_ties_are_rounded_and_chosen_as_in_sql(spark, coarse, name):
    df, answer = registry.QUERIES[name](spark, coarse), connect(coarse).execute(registry.SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in answer.description], answer.fetchall())
