"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every
step is an aggregation, combined before its shuffle, and a join of edges with their nodes' minima, so nothing
is gathered. The minima are broadcast while there are few of them; beyond that only those of hot
nodes are (``runtime.spread_join``), such as the centre of a large component, whose edges stay spread at any size.
The table of a round is deleted when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .runtime import cut, drop, spread_join


def _with_minimum(edges: DataFrame, low: DataFrame, size: int, used: list[DataFrame]) -> DataFrame:
    """``edges(u, v)`` with the minimum ``m`` of ``low(u, m, degree)``; ``size`` edges have at most so many nodes twice.

    Tables to delete after the round go to ``used``.
    """
    if 2 * size <= runtime.BROADCAST_IDS:
        return edges.join(F.broadcast(low.select("u", "m")), "u")
    low = cut(low)
    used.append(low)
    return spread_join(edges, low, ["u"], "degree", 2 * size).select("u", "v", "m")


def _large_star(edges: DataFrame, size: int, used: list[DataFrame]) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
    return _with_minimum(both.filter("v > u"), low, size, used).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, size: int, used: list[DataFrame]) -> DataFrame:
    """``edges`` with v < u."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    moved = _with_minimum(edges, low, size, used).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v")))


def _sign(edges: DataFrame):
    """(number of edges, a sum of their hashes): equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` to ``(node, component)``; the component is its smallest node.

    Self loops and repeated edges are allowed; an edge with a null end is
    ignored; nodes without edges don't appear. Raises if ``rounds`` rounds don't reach the end.
    """
    now = cut(edges.filter("u != v").select("u", "v").distinct())
    seen = _sign(now)
    for _ in range(rounds):
        used = [now]
        star = _large_star(now, seen[0], used)
        if 2 * seen[0] > runtime.BROADCAST_IDS:
            star = cut(star)
            used.append(star)
        after = cut(_small_star(star, seen[0], used).distinct())
        sign = _sign(after)
        for table in used:
            drop(table)
        now = after
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
