"""Provenance: parent edges, bounded expansion, and the summary of an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

ENTITY_TYPES = ("scene", "tile", "embedding", "search_query", "search_result", "change_analysis")
#: Results lead to tiles, queries and analyses, these to tiles, and tiles to scenes.
LONGEST_PATH = 4


def parent_edges(results: DataFrame, tiles: DataFrame, evidence: DataFrame) -> DataFrame:
    """(child_type, child_id, parent_type, parent_id) from the entities' own references."""

    def edges(df: DataFrame, child: str, child_col: str, parent: str, parent_col: str) -> DataFrame:
        return df.filter(F.col(parent_col).isNotNull()).select(F.lit(child).alias("child_type"), F.col(child_col).cast("string").alias("child_id"), F.lit(parent).alias("parent_type"), F.col(parent_col).cast("string").alias("parent_id"))

    parts = [
        edges(results, "search_result", "result_id", "tile", "tile_id"), edges(results, "search_result", "result_id", "search_query", "query_id"),
        edges(results, "search_result", "result_id", "change_analysis", "change_analysis_id"), edges(tiles, "tile", "tile_id", "scene", "scene_id"),
        edges(evidence, "change_analysis", "analysis_id", "tile", "before_tile_id"), edges(evidence, "change_analysis", "analysis_id", "tile", "after_tile_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def ancestors(starts: DataFrame, edges: DataFrame, depth: int = LONGEST_PATH) -> DataFrame:
    """``starts(start_type, start_id)`` with every entity they derive from, themselves included, and its least ``hops``.

    Unrolled to the bounded depth, each level a written table. Going up, only the distinct entities of each level are kept, and only edges from
    types that a level has are read; coming down, each gets what its parents derive from. Entities that many starts share are thus followed once, and all starts
    meet only in the last join.
    """
    up = cut(edges.select(F.col("child_type").alias("type"), F.col("child_id").alias("id"), "parent_type", "parent_id"))
    levels = [starts.select(F.col("start_type").alias("type"), F.col("start_id").cast("string").alias("id")).distinct()]
    levels[0] = cut(levels[0])
    steps_up: list[DataFrame] = []
    for _ in range(depth):
        types = [r.type for r in levels[-1].select("type").distinct().collect()]  # a few names
        step = cut(up.filter(F.col("type").isin(types)).join(levels[-1], ["type", "id"], "left_semi"))
        above = cut(step.select(F.col("parent_type").alias("type"), F.col("parent_id").alias("id")).distinct())
        if above.isEmpty():
            break
        steps_up.append(step)
        levels.append(above)
    own = lambda level: level.select("type", "id", F.col("type").alias("entity_type"), F.col("id").alias("entity_id"), F.lit(0).alias("hops"))
    found = own(levels[-1])
    for level, step in zip(reversed(levels[:-1]), reversed(steps_up), strict=True):
        above = found.withColumnsRenamed({"type": "parent_type", "id": "parent_id"})
        more = step.join(above, ["parent_type", "parent_id"]).select("type", "id", "entity_type", "entity_id", (F.col("hops") + 1).alias("hops"))
        found = own(level).unionByName(more).groupBy("type", "id", "entity_type", "entity_id").agg(F.min("hops").alias("hops"))
    same = starts.schema["start_id"].dataType
    return found.select(F.col("type").alias("start_type"), F.col("id").cast(same).alias("start_id"), "entity_type", "entity_id", "hops")


def steps(reached: DataFrame, records: DataFrame) -> DataFrame:
    """The records of all entities reached; a tile brings its embedding's records."""
    own = reached.select("start_type", "start_id", "entity_type", "entity_id")
    vectors = own.filter("entity_type = 'tile'").withColumn("entity_type", F.lit("embedding"))
    return own.unionByName(vectors).distinct().join(records, ["entity_type", "entity_id"])


def ordered_steps(reached: DataFrame, records: DataFrame) -> DataFrame:
    """:func:`steps` with ``step``: a start's records in the order of time (those without one first), type, id and the rest of the record, from 1."""
    rest = [c for c in records.columns if c not in ("created_at", "entity_type", "entity_id")]
    order = Window.partitionBy("start_type", "start_id").orderBy(F.asc_nulls_first("created_at"), "entity_type", "entity_id", *rest)
    return steps(reached, records).withColumn("step", F.row_number().over(order))


def summary(reached: DataFrame, records: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row a start: the last non-null value of each attribute in (time, type) order, counts, and ``complete``."""
    order = F.struct(F.col("created_at"), F.col("entity_type"))
    named = ["preprocessing_version", "embedding_model", "embedding_version", "change_model", "change_model_version"]
    last = [F.max_by(c, F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), order)).alias(c) for c in named]
    trail = steps(reached, records)
    done = trail.groupBy("start_type", "start_id").agg(F.count("*").alias("n_steps"), *last)
    from_scene = reached.filter("entity_type = 'scene'").select("start_type", "start_id", F.col("entity_id").alias("scene_id"))
    from_record = trail.filter("source_scene_id is not null").select("start_type", "start_id", F.col("source_scene_id").alias("scene_id"))
    known = from_scene.unionByName(from_record).distinct().join(scenes.select(F.col("scene_id").cast("string")), "scene_id", "left_semi")
    sources = known.groupBy("start_type", "start_id").agg(F.count("*").alias("n_scenes"))
    out = reached.select("start_type", "start_id").distinct().join(done, ["start_type", "start_id"], "left").join(sources, ["start_type", "start_id"], "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({"n_steps": F.coalesce("n_steps", zero), "n_scenes": F.coalesce("n_scenes", zero)})
    return out.withColumn("complete", (F.col("n_steps") > 0) & (F.col("n_scenes") > 0))
