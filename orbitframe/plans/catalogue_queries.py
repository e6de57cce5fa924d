"""Queries of filters, listings, text parts, dates and table upkeep."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.text import parse_queries, routed, shortened
from ..functions.times import day_gap, iso
from ..operators import search, tables
from ..operators.filters import TileFilter, scene_list, scene_total, tiles_of
from . import proxies as P
from .registry import register


@register("filter_metadata", f"""WITH {P.TILES}
SELECT tile_id, sensor, quality_score FROM tiles WHERE lower(platform) = 'view' AND acquisition_time <= TIMESTAMP '2024-01-20' AND location_key IN (1, 2, 3, 5, 8, 13) AND tile_id NOT IN (10, 20, 30)""")
def filter_metadata(spark, sf_dir):
    """Platform in any case, a last date, scenes by list, tiles left out."""
    rows = P.tiles(spark, sf_dir).withColumn("scene_id", F.col("location_key").cast("string"))
    where = TileFilter(platform="View", date_to=dt.datetime(2024, 1, 20), scene_ids=["1", "2", "3", "5", "8", "13"], exclude_tile_ids=[10, 20, 30])
    return where.apply(rows).select("tile_id", "sensor", "quality_score")


@register("filter_by_tables", f"""WITH {P.TILES}
SELECT tile_id, acquisition_time FROM tiles WHERE location_key IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 1) AND tile_id NOT IN (SELECT vec_id FROM embeddings)""")
def filter_by_tables(spark, sf_dir):
    """Scene and exclusion lists as tables: a semi join and an anti join."""
    rows = P.tiles(spark, sf_dir).withColumn("scene_id", F.col("location_key"))
    scenes = P.table(spark, sf_dir, "customer").filter("c_custkey % 3 = 1").select(F.col("c_custkey").alias("scene_id"))
    where = TileFilter(scene_ids=scenes, exclude_tile_ids=P.embeddings(spark, sf_dir))
    return where.apply(rows).select("tile_id", F.col("acquisition_time").cast("timestamp_ntz").alias("acquisition_time"))


@register("scene_listing", """SELECT o_orderkey AS scene_id, o_orderstatus AS status FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice / 1e6 >= 0.05 ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 20""")
def scene_listing(spark, sf_dir):
    """A page of the scenes of one status, newest first."""
    rows = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("acquisition_time"), (F.col("o_totalprice") / 1e6).alias("quality_score"))
    return scene_list(rows, TileFilter(min_quality=0.05), status="F", limit=50, offset=20).select("scene_id", "status")


@register("scene_tiles", "SELECT l_linenumber AS y_index, l_partkey AS x_index FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)")
def scene_tiles(spark, sf_dir):
    """The tiles of one scene, in reading order."""
    rows = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("y_index"), F.col("l_partkey").alias("x_index"))
    return tiles_of(rows, rows.agg(F.min("scene_id")).first()[0]).select("y_index", "x_index")


@register("season_gaps", """SELECT o_orderkey, CAST(min(least(abs(dayofyear(o_orderdate) - dayofyear(l_shipdate)), 365 - abs(dayofyear(o_orderdate) - dayofyear(l_shipdate)))) AS INT) AS least_gap,
CAST(max(least(abs(dayofyear(o_orderdate) - dayofyear(l_shipdate)), 365 - abs(dayofyear(o_orderdate) - dayofyear(l_shipdate)))) AS INT) AS largest_gap, strftime(max(l_shipdate)::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS last FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def season_gaps(spark, sf_dir):
    """How far apart in the year an order and its shipments are, and the last date as ISO text."""
    orders, lines = P.table(spark, sf_dir, "orders"), P.table(spark, sf_dir, "lineitem")
    gap = day_gap(F.col("o_orderdate"), F.col("l_shipdate"))
    return orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.min(gap).cast("int").alias("least_gap"), F.max(gap).cast("int").alias("largest_gap"), iso(F.max("l_shipdate").cast("timestamp")).alias("last"))


@register("table_upsert", """SELECT p_partkey AS id, p_size + 100 AS size FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, p_size FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0""")
def table_upsert(spark, sf_dir):
    part = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return tables.upserted(part.filter("id % 2 = 0"), part.filter("id % 3 = 0").withColumn("size", F.col("size") + 100), ["id"])


@register("table_insert_new", """SELECT l_partkey AS id, l_suppkey AS supplier FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1) GROUP BY l_partkey, l_suppkey""")
def table_insert_new(spark, sf_dir):
    lines = P.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("supplier"), "l_linenumber")
    return tables.missing_from(lines.drop("l_linenumber"), lines.filter("l_linenumber = 1"), ["id", "supplier"])


@register("scene_deletion", """WITH t AS (SELECT o_orderkey AS tile_id, o_custkey % 7 = 0 AS gone FROM orders), l AS (SELECT t.gone, l_linenumber AS n FROM lineitem JOIN t ON t.tile_id = l_orderkey)
SELECT 'scene' AS entity, CAST(count(*) FILTER (c_custkey % 7 <> 0) AS BIGINT) AS n FROM customer UNION ALL SELECT 'tile', CAST(count(*) FILTER (NOT gone) AS BIGINT) FROM t
UNION ALL SELECT 'embedding', CAST(count(*) FILTER (NOT gone AND n = 1) AS BIGINT) FROM l UNION ALL SELECT 'search_result', CAST(count(*) FILTER (NOT gone) AS BIGINT) FROM l
UNION ALL SELECT 'change_evidence', CAST(count(*) FILTER (NOT a.gone AND NOT coalesce(b.gone, FALSE)) AS BIGINT) FROM t a LEFT JOIN t b ON b.tile_id = a.tile_id + 1""")
def scene_deletion(spark, sf_dir):
    """What is left of each table when a seventh of the scenes go, with all that hangs on them."""
    customer, orders, lines = (P.table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    tile = orders.select(F.col("o_orderkey").alias("tile_id"), F.col("o_custkey").alias("scene_id"))
    result = lines.select(F.col("l_orderkey").alias("tile_id"), "l_linenumber")
    held = {
        "scene": customer.select(F.col("c_custkey").alias("scene_id")), "tile": tile, "embedding": result.filter("l_linenumber = 1"), "temporal_observation": result, "search_result": result,
        "change_evidence": tile.select(F.col("tile_id").alias("before_tile_id"), (F.col("tile_id") + 1).alias("after_tile_id")),
    }
    left = tables.delete_scene(held, held["scene"].filter("scene_id % 7 = 0"))
    counts = [left[n].agg(F.lit(n).alias("entity"), F.count("*").alias("n")) for n in ("scene", "tile", "embedding", "search_result", "change_evidence")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out


@register("stored_query_rows", """SELECT l_linenumber AS rank, l_partkey AS tile_id, l_discount AS confidence, s_name AS source_path FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = p_partkey % 10
WHERE l_orderkey = (SELECT max(o_orderkey) FROM orders)""")
def stored_query_rows(spark, sf_dir):
    """The rows of the latest persisted query with their tiles and scenes."""
    lines, part, supplier = (P.table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier"))
    results = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("tile_id"), F.col("l_linenumber").alias("rank"), F.col("l_discount").alias("final_score"))
    none = F.lit(None).cast("string")
    tile = part.select(F.col("p_partkey").alias("tile_id"), (F.col("p_partkey") % 10).alias("scene_id"), none.alias("acquisition_time"), none.alias("sensor"), none.alias("platform"), none.alias("geometry"))
    scenes = supplier.select(F.col("s_suppkey").alias("scene_id"), F.col("s_name").alias("source_path"), none.alias("checksum"))
    last = P.table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return search.stored_query(results, tile, scenes, last).select("rank", "tile_id", "confidence", "source_path")


VERBS = [("expanded", "expansion"), ("demolished", "disappearance"), ("flooded", "water_extent_change"), ("quiet", "")]
OBJECTS = [("warehouse", "built structures"), ("forest", "vegetation"), ("highway", "road"), ("quarry", "bare soil"), ("airfield", "aircraft")]
PLACES = ["lake", "harbour", "glacier"]
RELATED = ["near", "next to", "inside"]


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@register("query_text_parts", f"""WITH q AS (SELECT o_orderkey AS k, {_sql_list(v for _, v in VERBS)}[1 + o_custkey % 4] AS types, {_sql_list(v for _, v in OBJECTS)}[1 + o_orderkey % 5] AS objects, {_sql_list(RELATED)}[1 + o_orderkey // 5 % 3] AS relation,
  {_sql_list(PLACES)}[1 + o_custkey // 4 % 3] AS context, 1985 + o_orderkey % 40 AS y, o_custkey % 3 AS form FROM orders)
SELECT k AS query_id, types AS change_types, nullif(types, '') AS change_intent, objects, context, relation AS spatial_relation, TRUE AS temporal_intent, objects || ' ' || relation || ' ' || context AS embedding_text,
  CASE WHEN form <> 1 THEN make_date(y, 1, 1) END AS date_from, CASE form WHEN 1 THEN make_date(y, 1, 1) WHEN 2 THEN make_date(y + 3, 12, 31) END AS date_to FROM q""")
def query_text_parts(spark, sf_dir):
    """Texts put together from the orders' keys, with every part that parsing has to find again."""
    at = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    year = 1985 + k % 40
    when = F.when(c % 3 == 0, F.concat(F.lit("since "), year)).when(c % 3 == 1, F.concat(F.lit("before "), year)).otherwise(F.concat(F.lit("between "), year, F.lit(" and "), year + 3))
    text = F.concat_ws("  ", F.upper(at([v for v, _ in VERBS], c % 4)), at([v for v, _ in OBJECTS], k % 5), at(RELATED, F.floor(k / 5) % 3), at(PLACES, F.floor(c / 4) % 3), when)
    out = parse_queries(P.table(spark, sf_dir, "orders").select(k.alias("query_id"), text.alias("text")))
    joined = lambda name: F.array_join(name, ",").alias(name)
    return out.select("query_id", joined("change_types"), "change_intent", joined("objects"), joined("context"), "spatial_relation", "temporal_intent", "embedding_text", F.to_date("date_from").alias("date_from"), F.to_date("date_to").alias("date_to"))


@register("scene_totals", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice / 1e6 >= 0.05")
def scene_totals(spark, sf_dir):
    """How many scenes the pages of ``scene_listing`` have together."""
    rows = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("acquisition_time"), (F.col("o_totalprice") / 1e6).alias("quality_score"))
    return scene_total(rows, TileFilter(min_quality=0.05), status="F")


@register("model_listing", """SELECT p_name AS model_name, p_partkey AS version, p_type AS type FROM part
WHERE p_type = (SELECT min(p_type) FROM part) AND p_size >= 10""")
def model_listing(spark, sf_dir):
    """Active models of one type: parts of some size are the registry."""
    part = P.table(spark, sf_dir, "part").select(F.col("p_name").alias("model_name"), F.col("p_partkey").alias("version"), F.col("p_type").alias("type"), (F.col("p_size") >= 10).alias("active"))
    return tables.model_list(part, part.agg(F.min("type")).first()[0], active=True).drop("active")


@register("job_listing", """SELECT o_orderkey AS job_id, o_orderpriority AS job_type FROM orders
WHERE o_orderstatus = 'O' AND o_orderpriority = (SELECT max(o_orderpriority) FROM orders) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def job_listing(spark, sf_dir):
    """The newest open jobs of one kind: orders are the jobs."""
    orders = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("job_type"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return tables.job_list(orders, "O", orders.agg(F.max("job_type")).first()[0]).select("job_id", "job_type")


@register("batch_summaries", """SELECT l_orderkey AS batch_id, count(*) AS requested, count(*) FILTER (l_returnflag <> 'R') AS succeeded, count(*) FILTER (l_returnflag = 'R') AS failed,
count(*) FILTER (l_returnflag <> 'R' AND l_linenumber > 3) AS duplicates FROM lineitem GROUP BY l_orderkey""")
def batch_summaries(spark, sf_dir):
    """What became of each batch: an order is one, its lines are the files."""
    files = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.when(F.col("l_returnflag") == "R", F.lit("unreadable")).alias("error"), (F.col("l_linenumber") > 3).alias("duplicate"))
    return tables.batch_summary(files, ["batch_id"])


#: Keywords and whole texts of document groups.
KEYWORDS = {"licence": ["license", "copyright"], "secret": ["password", "token", "secret"], "contact": ["@"]}


@register("document_routes", """SELECT doc_id, CASE WHEN contains(t, 'license') OR contains(t, 'copyright') THEN 'licence' WHEN contains(t, 'password') OR contains(t, 'token') OR contains(t, 'secret') THEN 'secret' WHEN contains(t, '@') THEN 'contact' END AS route, head
FROM (SELECT doc_id, lower(text) AS t, substring(text, 1, 256) AS head FROM documents)""")
def document_routes(spark, sf_dir):
    """The first group of keywords in each whole text, and the text cut as tags are."""
    docs = P.table(spark, sf_dir, "documents")
    return docs.select("doc_id", routed(F.col("text"), KEYWORDS).alias("route"), shortened(F.col("text"), 256).alias("head"))
