"""Entity tables on Parquet: append, upsert by key, anti-join inserts, audits, deletes.

One writer a table. A rewrite goes to a new folder of the table, and readers follow the
folder named last, so a job that dies half-way leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import KEYS, TABLES, empty


class Store:
    """Entity tables under one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.schema("n LONG, folder STRING").json(f"{self.root}/{name}/versions")
        except Exception as e:  # Spark's own class differs between the classic and the connect client
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _folder(self, name: str) -> tuple[int, str] | None:
        versions = self._versions(name)
        last = versions.orderBy(F.desc("n")).head() if versions is not None else None
        return (last.n, last.folder) if last else None

    def read(self, name: str) -> DataFrame:
        at = self._folder(name)
        return empty(self.spark, name) if at is None else self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/{at[1]}")

    def _fit(self, name: str, rows: DataFrame) -> DataFrame:
        want = empty(self.spark, name).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])

    def _publish(self, name: str, n: int, folder: str) -> None:
        self.spark.createDataFrame([(n, folder)], "n LONG, folder STRING").coalesce(1).write.mode("append").json(f"{self.root}/{name}/versions")

    def append(self, name: str, rows: DataFrame) -> None:
        at = self._folder(name)
        folder = at[1] if at else uuid.uuid4().hex
        self._fit(name, rows).write.mode("append").parquet(f"{self.root}/{name}/{folder}")
        if at is None:
            self._publish(name, 1, folder)

    def replace(self, name: str, rows: DataFrame) -> None:
        at, folder = self._folder(name), uuid.uuid4().hex
        self._fit(name, rows).write.parquet(f"{self.root}/{name}/{folder}")
        self._publish(name, at[0] + 1 if at else 1, folder)

    def upsert(self, name: str, rows: DataFrame) -> None:
        self.replace(name, upserted(self.read(name), self._fit(name, rows), KEYS[name]))

    def insert_new(self, name: str, rows: DataFrame) -> None:
        self.append(name, missing_from(self._fit(name, rows), self.read(name), KEYS[name]))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with rows of ``new`` in place of those with the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def missing_from(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def new_vectors(vectors: DataFrame, embeddings: DataFrame, model: str, version: str) -> DataFrame:
    """Vectors of tiles that the model has none for, with ids from the largest one on.

    Ids are dense: rows are numbered within hash buckets, and buckets are offset by running totals.
    """
    own = embeddings.filter((F.col("model_name") == model) & (F.col("model_version") == version))
    rows = missing_from(vectors, own, ["tile_id"]).withColumn("_b", F.pmod(F.xxhash64("tile_id"), F.lit(1024)))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_before")  # 1024 rows
    top = own.agg(F.coalesce(F.max("vector_id"), F.lit(-1)).alias("_top"))
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("tile_id"))).join(F.broadcast(before), "_b").crossJoin(top)  # one row
    out = numbered.withColumn("vector_id", F.col("_top") + F.col("_before") + F.col("_i"))
    return out.withColumns({"model_name": F.lit(model), "model_version": F.lit(version)}).drop("_b", "_i", "_before", "_top")


def reconcile(embeddings: DataFrame, index: DataFrame) -> DataFrame:
    """One row: vectors missing from an index, entries without a vector, and both sizes."""
    both = embeddings.select("vector_id", F.lit(1).alias("a")).join(index.select("vector_id", F.lit(1).alias("b")), "vector_id", "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("to_restore"), F.count_if(F.col("a").isNull()).alias("orphans"), F.count("a").alias("n_table"), F.count("b").alias("n_index"))


def register_models(registry: DataFrame, cards: DataFrame) -> DataFrame:
    """The registry with ``cards`` in it; of a type only the versions registered now stay active."""
    cards = cards.withColumn("active", F.lit(True))
    kept = upserted(registry, cards.select(*registry.columns), ["model_name", "version"])
    fresh = cards.select("type", "model_name", "version").withColumn("_now", F.lit(True))
    types = cards.select("type").distinct().withColumn("_touched", F.lit(True))
    out = kept.join(fresh, ["type", "model_name", "version"], "left").join(types, "type", "left")
    return out.withColumn("active", F.when(F.col("_touched") & F.col("_now").isNull(), F.lit(False)).otherwise(F.col("active"))).select(*registry.columns)


def delete_scene(tables: dict[str, DataFrame], scene_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the scenes and what hangs on them; provenance stays."""
    gone = tables["tile"].join(scene_ids, "scene_id", "left_semi").select("tile_id")
    out = dict(tables)
    out["scene"] = tables["scene"].join(scene_ids, "scene_id", "left_anti")
    for name in ("tile", "embedding", "temporal_observation", "search_result"):
        out[name] = tables[name].join(gone, "tile_id", "left_anti")
    evidence = tables["change_evidence"]
    for side in ("before_tile_id", "after_tile_id"):
        evidence = evidence.join(gone.withColumnRenamed("tile_id", side), side, "left_anti")
    out["change_evidence"] = evidence.select(*tables["change_evidence"].columns)
    return out


def scene_quality(tiles: DataFrame) -> DataFrame:
    """Mean quality (0 without tiles' values) and cloud share of each scene's tiles."""
    return tiles.groupBy("scene_id").agg(F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("quality_score"), F.avg("cloud_percentage").alias("cloud_percentage"), F.count("*").alias("tile_count"))


def model_list(registry: DataFrame, type: str | None = None, active: bool | None = None) -> DataFrame:
    """The registered models of a type, of a state, or all, by type and name."""
    if type:
        registry = registry.filter(F.col("type") == type)
    if active is not None:
        registry = registry.filter(F.col("active") == active)
    return registry.orderBy("type", "model_name")


def job_list(jobs: DataFrame, status: str | None = None, job_type: str | None = None, limit: int = 50) -> DataFrame:
    """The newest jobs of a status and type; job ids break ties."""
    for name, value in (("status", status), ("job_type", job_type)):
        if value:
            jobs = jobs.filter(F.col(name) == value)
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(limit)


def batch_summary(files: DataFrame, by: list[str]) -> DataFrame:
    """How many of a batch's files were asked for, ingested, failed (an ``error``), and there before (``duplicate``)."""
    ok = F.col("error").isNull()
    return files.groupBy(*by).agg(F.count("*").alias("requested"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if(ok & F.col("duplicate")).alias("duplicates"))
