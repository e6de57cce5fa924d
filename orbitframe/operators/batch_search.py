"""Search for a table of queries: parsed texts to ranked rows, each query with its own filter.

Queries go in blocks of bounded size, which are sent to the tasks; a task multiplies a block with batches of vectors, and
keeps, for each of its queries, the best tiles that pass that query's filter. Only these partial pools are shuffled, so
no pair of a query and a tile is, and the tiles are read once a block of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, Settings
from ..functions import scores as S
from ..functions.spatial import BOX
from ..functions.text import parse_queries
from ..functions.vectors import clip, mean_of
from ..session import cut
from .encoders import encode_text
from .filters import check_top_k

#: Queries multiplied with vectors at once: with 256 dimensions 4 MB.
QUERY_BLOCK = 2048
#: Rows of vectors multiplied at once.
VECTOR_ROWS = 1024
#: Tasks' pools are merged in so many parts before the last merge.
PARTS = 64

#: What a query may ask of a tile; a null asks nothing.
ASKED = {
    "date_from": "timestamp", "date_to": "timestamp", "sensor": "string", "platform": "string", "min_quality": "double", "max_cloud": "double",
    **{f"q_{c}": "double" for c in BOX},
}
TILE = {"acquisition_time": "timestamp", "sensor": "string", "platform": "string", "quality_score": "double", "cloud_percentage": "double", **dict.fromkeys(BOX, "double")}


def text_queries(texts: DataFrame, now: Column | None = None, dim: int = DEFAULTS.embedding_dim, seed: int = DEFAULTS.embedding_seed) -> DataFrame:
    """``texts(query_id, text, ...)`` parsed, with ``vector``; empty texts are left out. Explicit dates win over those of the text.

    Equal texts are encoded once.
    """
    asked = texts.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    # parsed once, so that what follows needn't parse again
    parsed = cut(parse_queries(cut(asked.select("text").distinct()), now)).withColumn("said", F.coalesce(F.nullif(F.col("embedding_text"), F.lit("")), F.col("text")))

    def run(batches):
        for batch in batches:
            vectors = [encode_text(t, dim, seed) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["said", "vector"])

    vectors = parsed.select("said").distinct().mapInArrow(run, "said string, vector array<double>")
    parsed = cut(parsed.join(vectors, "said").select("text", "vector", "context", "temporal_intent", F.col("date_from").alias("said_from"), F.col("date_to").alias("said_to")))
    given = [c for c in asked.columns if c not in ("date_from", "date_to")]
    explicit = lambda c: F.col(c) if c in asked.columns else F.lit(None).cast("timestamp")
    out = asked.join(parsed, "text")
    return out.select(*given, "vector", "context", "temporal_intent", F.coalesce(explicit("date_from"), "said_from").alias("date_from"), F.coalesce(explicit("date_to"), "said_to").alias("date_to"))


def _wanted(rows: DataFrame, columns: dict[str, str]) -> list[Column]:
    return [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]


def _passes(q: dict[str, np.ndarray], t: dict[str, np.ndarray]) -> np.ndarray:
    """Which tiles (columns) pass which query's filter (rows); comparisons with a missing tile value fail."""
    out = np.ones((len(q["date_from"]), len(t["quality_score"])), dtype=bool)
    pairs = [("date_from", "acquisition_time", np.less_equal), ("date_to", "acquisition_time", np.greater_equal), ("min_quality", "quality_score", np.less_equal), ("max_cloud", "cloud_percentage", np.greater_equal)]
    pairs += [("q_min_x", "max_x", np.less_equal), ("q_min_y", "max_y", np.less_equal), ("q_max_x", "min_x", np.greater_equal), ("q_max_y", "min_y", np.greater_equal)]
    for asked, has, holds in pairs:
        given = ~np.isnan(q[asked])
        if given.any():
            out[given] &= holds(q[asked][given][:, None], t[has][None, :])
    for c in ("sensor", "platform"):
        given = np.array([v is not None and v != "" for v in q[c]])
        if given.any():
            out[given] &= q[c][given][:, None] == t[c][None, :]
    return out


def _plain(columns: dict[str, str], batch) -> dict[str, np.ndarray]:
    """Arrays of a batch's columns: numbers as doubles (times in microseconds), texts as they are; a missing number is NaN."""
    out = {}
    for name, kind in columns.items():
        column = batch.column(name)
        if kind == "string":
            out[name] = np.array(column.to_pylist(), dtype=object)
        else:
            column = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()) if kind == "timestamp" else column
            out[name] = column.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    return out


def batch_pools(queries: DataFrame, tiles: DataFrame, embeddings: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, tile_id, vector_id, sim)``: the ``k`` most similar tiles of each query that pass its filter. Ties go by vector id.

    ``queries(query_id, vector, ...)`` with any of ASKED's columns; repeated query ids are queries of their own only if their rows are equal.
    """
    spark = queries.sparkSession
    lower = lambda rows: rows.withColumns({c: F.lower(c) for c in ("sensor", "platform") if c in rows.columns})
    asked = lower(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), *_wanted(queries, ASKED)))
    held = lower(tiles.select("tile_id", *_wanted(tiles, TILE))).join(embeddings.select("tile_id", F.col("vector_id").cast("long").alias("vector_id"), "vector"), "tile_id")
    asked = cut(asked.dropDuplicates(["query_id"]))
    n = asked.count()
    kind, tile_kind = queries.schema["query_id"].dataType, tiles.schema["tile_id"].dataType
    if not n:
        return spark.createDataFrame([], f"query_id {kind.simpleString()}, tile_id {tile_kind.simpleString()}, vector_id long, sim double")
    asked = cut(asked.withColumn("at", F.pmod(F.xxhash64("query_id"), F.lit(-(-n // block)))))
    out = None
    for b in range(-(-n // block)):
        part = asked.filter(F.col("at") == b).drop("at").toArrow()  # one block of queries
        if not part.num_rows:
            continue
        sent = spark.sparkContext.broadcast(part)

        def run(batches, sent=sent):
            q = sent.value
            matrix = np.array(q.column("vector").to_pylist(), dtype=np.float64)
            wants = _plain(ASKED, q.combine_chunks().to_batches()[0])
            found, least = [], np.full(len(matrix), -np.inf)

            def best():
                rows, sims, ids, tile = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((ids, -sims, rows))
                rows = rows[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                keep = order[place < k]
                full = order[place == k - 1]
                least[(rows_of := np.concatenate([f[0] for f in found]))[full]] = np.concatenate([f[1] for f in found])[full]
                return rows_of[keep], sims[keep], ids[keep], tile[keep]

            for batch in batches:
                for low in range(0, batch.num_rows, VECTOR_ROWS):
                    piece = batch.slice(low, VECTOR_ROWS)
                    vectors = np.array(piece.column("vector").to_pylist(), dtype=np.float64)
                    sims = matrix @ vectors.T
                    row, col = np.nonzero((sims >= least[:, None]) & _passes(wants, _plain(TILE, piece)))
                    tile = np.array(piece.column("tile_id").to_pylist(), dtype=object)
                    found.append((row, sims[row, col], piece.column("vector_id").to_numpy()[col], tile[col]))
                    if sum(len(f[0]) for f in found) > 4 * k * len(matrix):
                        found[:] = [best()]
            if found:
                rows, sims, ids, tile = best()
                names = q.column("query_id").combine_chunks()
                kind = batch_type(tile_kind)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(rows)), pa.array(tile.tolist(), kind), pa.array(ids, pa.int64()), pa.array(sims)], ["query_id", "tile_id", "vector_id", "sim"])

        mine = held.mapInArrow(run, f"query_id {kind.simpleString()}, tile_id {tile_kind.simpleString()}, vector_id long, sim double")
        out = mine if out is None else out.unionAll(mine)
    order = [F.desc("sim"), F.col("vector_id")]
    parted = out.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    top = lambda rows, *keys: rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= k)
    return top(top(parted, "query_id", "part"), "query_id").drop("part", "place")


def batch_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _scores(rows: DataFrame) -> DataFrame:
    """Adds the components of each row's own query, and which of them apply (a null doesn't)."""
    zero = F.lit(0.0)
    same = lambda c: F.when(F.col(f"asked_{c}") != "", (F.lower(F.coalesce(F.col(c), F.lit(""))) == F.lower(f"asked_{c}")).cast("double"))
    asks = lambda words: F.arrays_overlap("asked_context", F.array(*map(F.lit, words)))
    parts = [same("sensor"), same("platform"), clip(1 - F.coalesce("cloud_percentage", zero) / 100), clip(F.coalesce("valid_pixel_percentage", zero) / 100)]
    if "features" in rows.columns:
        parts += [F.when(asks(words), S.context_score(F.element_at("features", name), least)) for name, (words, least) in S.CONTEXT_FEATURES.items()]
    wide = F.greatest(zero, F.least("max_x", "q_max_x") - F.greatest("min_x", "q_min_x"))
    high = F.greatest(zero, F.least("max_y", "q_max_y") - F.greatest("min_y", "q_min_y"))
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    covered = F.when(F.col("min_x").isNotNull() & (area > 0), clip(wide * high / F.nullif(area, zero))).otherwise(zero)
    timed = F.col("acquisition_time").isNotNull()
    pool = Window.partitionBy("query_id")  # a pool of bounded size
    n = F.count("acquisition_time").over(pool)
    share = F.cume_dist().over(Window.partitionBy("query_id", timed).orderBy("acquisition_time"))
    temporal = F.when(~timed | (n == 0), F.lit(0.5)).when(n == 1, F.lit(1.0)).otherwise(share)
    dated = F.col("temporal_intent") | F.col("asked_from").isNotNull() | F.col("asked_to").isNotNull()
    return rows.withColumns({
        "semantic": clip(F.col("sim")), "quality": F.coalesce("quality_score", zero), "metadata": mean_of(parts),
        "spatial": F.when(F.col("q_min_x").isNotNull(), covered), "temporal": F.when(dated, temporal),
    })


def search_batch(queries: DataFrame, tiles: DataFrame, embeddings: DataFrame, top_k: int = 20, by_location: bool = True, settings: Settings = DEFAULTS) -> DataFrame:
    """The ranked tiles of each of ``queries(query_id, vector, ...)``, as :func:`orbitframe.operators.search.search` ranks those of one.

    Queries may have ``temporal_intent``, ``context`` and the columns of ASKED. Adds ``query_id, sim``, the components,
    ``final_score, confidence, rank`` to the tiles' columns. Windows are over one query's pool, ``top_k * pool_factor`` rows.
    """
    check_top_k(top_k)
    asked = queries.select(
        "query_id", *[c.alias(f"asked_{n}" if n in ("sensor", "platform") else {"date_from": "asked_from", "date_to": "asked_to"}.get(n, n)) for c, n in zip(_wanted(queries, ASKED), ASKED, strict=True)],
        (F.coalesce("temporal_intent", F.lit(False)) if "temporal_intent" in queries.columns else F.lit(False)).alias("temporal_intent"), (F.col("context") if "context" in queries.columns else F.array().cast("array<string>")).alias("asked_context"),
    ).dropDuplicates(["query_id"])
    pools = cut(batch_pools(queries, tiles, embeddings, top_k * settings.pool_factor))
    rows = _scores(pools.join(tiles, "tile_id").join(asked, "query_id"))
    used = [c for c in ("semantic", "quality", "metadata", "spatial", "temporal") if settings.weights.get(c, 0) > 0]
    weight = lambda c: F.when(F.col(c).isNotNull(), F.lit(settings.weights[c])).otherwise(0.0)
    total = sum((weight(c) for c in used), F.lit(0.0))
    final = sum((F.coalesce(F.col(c), F.lit(0.0)) * weight(c) for c in used), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
    rows = rows.withColumn("final_score", F.coalesce(final, "semantic"))
    rows = rows.withColumn("confidence", 0.5 * F.col("final_score") + 0.5 * F.least("semantic", "quality"))
    order = [F.desc("final_score"), F.col("tile_id")]
    if by_location:
        place = F.coalesce(F.nullif(F.col("location_key").cast("string"), F.lit("")), F.col("tile_id").cast("string"))
        rows = rows.withColumn("_best", F.row_number().over(Window.partitionBy("query_id", place).orderBy(*order))).filter("_best = 1").drop("_best")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= top_k)
    return rows.drop("asked_sensor", "asked_platform", "asked_from", "asked_to", "asked_context", "temporal_intent", *[f"q_{c}" for c in BOX])


def search_texts(texts: DataFrame, tiles: DataFrame, embeddings: DataFrame, top_k: int = 20, now: Column | None = None, dim: int = DEFAULTS.embedding_dim, seed: int = DEFAULTS.embedding_seed, settings: Settings = DEFAULTS) -> DataFrame:
    """Ranked tiles of each text of ``texts(query_id, text, ...)``: parsing, encoding, filters and ranking in one."""
    return search_batch(text_queries(texts, now, dim, seed), tiles, embeddings, top_k, settings=settings)
