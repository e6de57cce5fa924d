"""Queries of reviews, evaluation, lineage, discovery, text and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import parse_queries
from ..functions.times import parse_datetime
from ..operators import clusters, evaluation, lineage, review
from ..sources import files
from ..streaming.ingest import activity_windows
from . import proxies as P
from .registry import register

COUNTS = """CAST(count(*) FILTER (decision = 'accept') AS BIGINT) AS accept, CAST(count(*) FILTER (decision = 'reject') AS BIGINT) AS reject, CAST(count(*) FILTER (decision = 'uncertain') AS BIGINT) AS uncertain,
       round(count(*) FILTER (decision = 'accept') / nullif(count(*) FILTER (decision IN ('accept', 'reject')), 0), 6) AS precision"""


def _rounded(df):
    return df.withColumn("precision", F.round("precision", 6))


def _once(spark, sf_dir):
    """Reviews without the columns that differ between line items of one id."""
    return P.reviews(spark, sf_dir).groupBy("review_id").agg(*[F.max(c).alias(c) for c in ("result_id", "query_id", "decision", "analyst_id", "timestamp", "score", "result_type", "change_type")])


ONCE = f"""{P.REVIEWS.replace("reviews AS", "raw AS", 1)},
reviews AS (SELECT review_id, max(result_id) AS result_id, max(query_id) AS query_id, max(decision) AS decision, max(analyst_id) AS analyst_id, max(timestamp) AS timestamp, max(score) AS score, max(result_type) AS result_type, max(change_type) AS change_type FROM raw GROUP BY review_id),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY timestamp DESC, review_id DESC) AS r FROM reviews) WHERE r = 1)"""


def _last(spark, sf_dir):
    return review.latest_reviews(_once(spark, sf_dir))


@register("review_decisions", f"WITH {ONCE} SELECT result_type, {COUNTS} FROM latest GROUP BY result_type")
def review_decisions(spark, sf_dir):
    return _rounded(review.decision_counts(_last(spark, sf_dir), "result_type"))


@register("review_by_change_type", f"WITH {ONCE} SELECT coalesce(change_type, 'unknown') AS change_type, {COUNTS} FROM latest WHERE result_type = 'change_analysis' GROUP BY 1")
def review_by_change_type(spark, sf_dir):
    return _rounded(review.by_change_type(_last(spark, sf_dir)))


@register("review_calibration", f"WITH {ONCE}, b AS (SELECT *, CAST(least(floor(score * 10), 9) AS INT) AS i FROM latest) SELECT printf('%.1f-%.1f', i / 10.0, (i + 1) / 10.0) AS bucket, {COUNTS} FROM b GROUP BY i")
def review_calibration(spark, sf_dir):
    return _rounded(review.calibration(_last(spark, sf_dir)))


@register("review_conflicts", f"WITH {ONCE} SELECT result_id, CAST(count(*) AS BIGINT) AS reviews FROM reviews GROUP BY result_id HAVING count(*) > 1 AND count(DISTINCT decision) > 1")
def review_conflicts(spark, sf_dir):
    return review.conflicting(_once(spark, sf_dir))


@register("review_totals", f"WITH {ONCE} SELECT CAST(count(*) AS BIGINT) AS total_reviews, CAST(count(DISTINCT result_id) AS BIGINT) AS reviewed_items, CAST(count(DISTINCT analyst_id) AS BIGINT) AS analysts, CAST(count(DISTINCT query_id) AS BIGINT) AS queries_reviewed FROM reviews")
def review_totals(spark, sf_dir):
    return review.totals(_once(spark, sf_dir))


@register("review_hard_negatives", f"WITH {ONCE} SELECT result_id, round(score, 6) AS score, review_id FROM latest WHERE decision = 'reject' AND score >= 0.5 ORDER BY latest.score DESC, result_id LIMIT 1000")
def review_hard_negatives(spark, sf_dir):
    return review.hard_negatives(_last(spark, sf_dir)).select("result_id", F.round("score", 6).alias("score"), "review_id")


@register("review_training_rows", f"WITH {ONCE} SELECT latest.query_id, result_id, decision AS label, o_orderpriority AS query_type FROM latest LEFT JOIN orders ON o_orderkey = latest.query_id WHERE result_type = 'search_result'")
def review_training_rows(spark, sf_dir):
    queries = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit("").alias("query_text"), F.col("o_orderpriority").alias("query_type"), F.lit("m").alias("embedding_model"))
    return review.training_rows(_last(spark, sf_dir), queries).select("query_id", "result_id", "label", "query_type")


@register("review_history", f"WITH {ONCE} SELECT review_id, timestamp FROM reviews WHERE decision = 'accept' AND timestamp >= TIMESTAMP '1995-01-01' ORDER BY timestamp DESC, review_id DESC LIMIT 100")
def review_history(spark, sf_dir):
    import datetime as dt

    return review.review_history(_once(spark, sf_dir), decision="accept", date_from=dt.datetime(1995, 1, 1)).limit(100).select("review_id", "timestamp")


@register("review_queue", """WITH items AS (
  SELECT 'change_analysis' AS item_type, 'chg_' || o_orderkey AS id, (o_totalprice % 1000) / 1000 AS confidence, o_orderdate AS time, o_orderstatus AS status FROM orders
  UNION ALL SELECT 'search_result', 'res_' || event_id, least(value / 100, 1.0), ts, 'O' FROM events)
SELECT item_type, id, round(confidence, 6) AS confidence FROM items WHERE status = 'O' AND confidence >= 0.1 AND confidence <= 0.9 ORDER BY abs(items.confidence - 0.5), id LIMIT 50""")
def review_queue(spark, sf_dir):
    analyses = P.table(spark, sf_dir, "orders").select(F.concat(F.lit("chg_"), F.col("o_orderkey").cast("string")).alias("analysis_id"), ((F.col("o_totalprice") % 1000) / 1000).alias("confidence"), F.lit("construction").alias("change_type"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("earliest_supported_time"))
    tiles = P.tiles(spark, sf_dir)
    results = tiles.select(F.concat(F.lit("res_"), F.col("tile_id").cast("string")).alias("result_id"), "tile_id", F.col("quality_score").alias("final_score"), F.lit("O").alias("status"))
    evidence = analyses.select("analysis_id", F.lit(0).alias("after_tile_id"))
    out = review.review_queue(analyses, evidence, results, tiles, status="O", min_confidence=0.1, max_confidence=0.9)
    return out.limit(50).select("item_type", "id", F.round("confidence", 6).alias("confidence"))


RANKED = """ranked AS (SELECT o_custkey AS query_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderpriority IN ('1-URGENT', '2-HIGH') AS hit FROM orders),
m AS (SELECT query_id, count(*) FILTER (hit) AS n, count(*) FILTER (hit AND rank <= 5) AS h, sum(CASE WHEN hit AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, min(rank) FILTER (hit) AS first FROM ranked GROUP BY query_id HAVING count(*) FILTER (hit) > 0),
e AS (SELECT query_id, n, h / 5 AS precision_5, h / n AS recall_5, dcg / (SELECT sum(1 / log2(i + 1)) FROM generate_series(1, 5) g(i) WHERE i <= n) AS ndcg_5, 1 / first AS mrr FROM m)"""


def _metrics(spark, sf_dir):
    from pyspark.sql.window import Window

    o = P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id"), "o_totalprice", "o_orderpriority")
    ranked = o.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("o_totalprice"), "item_id")))
    return evaluation.retrieval_metrics(ranked.select("query_id", "item_id", "rank"), o.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), [5])


@register("evaluation_by_query", f"WITH {RANKED} SELECT query_id, round(precision_5, 6) AS precision_5, round(recall_5, 6) AS recall_5, round(ndcg_5, 6) AS ndcg_5, round(mrr, 6) AS mrr FROM e")
def evaluation_by_query(spark, sf_dir):
    return _metrics(spark, sf_dir).select("query_id", *[F.round(c, 6).alias(c) for c in ("precision_5", "recall_5", "ndcg_5", "mrr")])


@register("evaluation_macro", f"WITH {RANKED} SELECT CAST(count(*) AS BIGINT) AS queries_evaluated, round(avg(precision_5), 6) AS precision_5, round(avg(recall_5), 6) AS recall_5, round(avg(ndcg_5), 6) AS ndcg_5, round(avg(mrr), 6) AS mrr FROM e")
def evaluation_macro(spark, sf_dir):
    out = evaluation.macro_average(_metrics(spark, sf_dir))
    return out.select("queries_evaluated", *[F.round(c, 6).alias(c) for c in ("precision_5", "recall_5", "ndcg_5", "mrr")])


@register("evaluation_truth_matches")
def evaluation_truth_matches(spark, sf_dir):
    """Tiles of good quality as detections, matched one to one with customers' boxes as truth."""
    d = P.tiles(spark, sf_dir).filter("quality_score > 0.9").select(F.col("tile_id").alias("det_id"), F.col("quality_score").alias("confidence"), *spatial_box())
    t = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("truth_id"), (F.col("c_custkey") % 300 - 150).cast("double").alias("min_x"), (F.col("c_custkey") % 140 - 70).cast("double").alias("min_y"))
    t = t.withColumns({"max_x": F.col("min_x") + 2, "max_y": F.col("min_y") + 2})
    return evaluation.match_truth(d, t, cell=10.0)


def spatial_box():
    return ["min_x", "min_y", "max_x", "max_y"]


EDGES = """edges AS (SELECT 'line' AS ct, concat_ws('-', l_orderkey, l_linenumber) AS cid, 'order' AS pt, CAST(l_orderkey AS VARCHAR) AS pid FROM lineitem
  UNION SELECT 'order', CAST(o_orderkey AS VARCHAR), 'customer', CAST(o_custkey AS VARCHAR) FROM orders
  UNION SELECT 'customer', CAST(c_custkey AS VARCHAR), 'nation', CAST(c_nationkey AS VARCHAR) FROM customer
  UNION SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'region', CAST(n_regionkey AS VARCHAR) FROM nation)"""


def _edges(spark, sf_dir):
    def edge(table, ct, cid, pt, pid):
        return P.table(spark, sf_dir, table).select(F.lit(ct).alias("child_type"), F.expr(cid).cast("string").alias("child_id"), F.lit(pt).alias("parent_type"), F.col(pid).cast("string").alias("parent_id"))

    out = edge("lineitem", "line", "concat_ws('-', l_orderkey, l_linenumber)", "order", "l_orderkey")
    for args in (("orders", "order", "o_orderkey", "customer", "o_custkey"), ("customer", "customer", "c_custkey", "nation", "c_nationkey"), ("nation", "nation", "n_nationkey", "region", "n_regionkey")):
        out = out.unionByName(edge(*args))
    return out  # each edge once, as keys are


@register("lineage_ancestors", f"""WITH RECURSIVE {EDGES},
up AS (SELECT cid AS start_id, ct AS et, cid AS eid, 0 AS hops FROM edges WHERE ct = 'line' UNION SELECT u.start_id, e.pt, e.pid, u.hops + 1 FROM up u JOIN edges e ON e.ct = u.et AND e.cid = u.eid)
SELECT start_id, et AS entity_type, eid AS entity_id, CAST(min(hops) AS INT) AS hops FROM up GROUP BY ALL""")
def lineage_ancestors(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    starts = edges.filter("child_type = 'line'").select(F.lit("line").alias("start_type"), F.col("child_id").alias("start_id")).distinct()
    return lineage.ancestors(starts, edges).select("start_id", "entity_type", "entity_id", "hops")


@register("lineage_steps", """WITH up AS (SELECT 'order' AS et, o_orderkey AS id, o_orderkey AS start FROM orders UNION ALL SELECT 'customer', o_custkey, o_orderkey FROM orders),
rec AS (SELECT 'order' AS et, l_orderkey AS id, l_shipdate AS created_at, l_linestatus AS model FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT 'customer', o_custkey, min(o_orderdate), 'C' FROM orders GROUP BY o_custkey)
SELECT CAST(start AS VARCHAR) AS start_id, CAST(row_number() OVER (PARTITION BY start ORDER BY created_at NULLS FIRST, up.et, up.id, model) AS INT) AS step, up.et AS entity_type, CAST(up.id AS VARCHAR) AS entity_id, model FROM up JOIN rec ON rec.et = up.et AND rec.id = up.id""")
def lineage_steps(spark, sf_dir):
    """The records of each order and its customer, in the order of time."""
    orders, lines = P.table(spark, sf_dir, "orders"), P.table(spark, sf_dir, "lineitem")
    reach = lambda kind, c: orders.select(F.lit("order").alias("start_type"), F.col("o_orderkey").cast("string").alias("start_id"), F.lit(kind).alias("entity_type"), F.col(c).cast("string").alias("entity_id"))
    own = lines.filter("l_linenumber = 1").select(F.lit("order").alias("entity_type"), F.col("l_orderkey").cast("string").alias("entity_id"), F.col("l_shipdate").alias("created_at"), F.col("l_linestatus").alias("model"))
    of_customer = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at")).select(F.lit("customer").alias("entity_type"), F.col("o_custkey").cast("string").alias("entity_id"), "created_at", F.lit("C").alias("model"))
    rows = lineage.ordered_steps(reach("order", "o_orderkey").unionByName(reach("customer", "o_custkey")), own.unionByName(of_customer))
    return rows.select("start_id", "step", "entity_type", "entity_id", "model")


@register("lineage_latest", """SELECT 'order' AS start_type, CAST(o_orderkey AS VARCHAR) AS start_id, CAST(count(*) AS BIGINT) AS n_steps, arg_max(l_linestatus, (l_shipdate, l_partkey)) AS embedding_model
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def lineage_latest(spark, sf_dir):
    reached = P.table(spark, sf_dir, "orders").select(F.lit("order").alias("start_type"), F.col("o_orderkey").cast("string").alias("start_id"), F.lit("order").alias("entity_type"), F.col("o_orderkey").cast("string").alias("entity_id"))
    none = F.lit(None).cast("string")
    records = P.table(spark, sf_dir, "lineitem").select(F.lit("order").alias("entity_type"), F.col("l_orderkey").cast("string").alias("entity_id"), none.alias("source_scene_id"), none.alias("preprocessing_version"), F.col("l_linestatus").alias("embedding_model"), none.alias("embedding_version"), none.alias("change_model"), none.alias("change_model_version"), F.struct("l_shipdate", "l_partkey").alias("created_at"))
    scenes = P.table(spark, sf_dir, "customer").select(F.col("c_name").alias("scene_id"))
    return lineage.summary(reached, records, scenes).filter("n_steps > 0").select("start_type", "start_id", "n_steps", "embedding_model")


@register("cluster_summaries", """WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY label, d),
n AS (SELECT label, d, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-12) AS c FROM m), s AS (SELECT vec_id, label, sum(CAST(v AS DOUBLE) * c) AS sim FROM x JOIN n USING (label, d) GROUP BY vec_id, label)
SELECT CAST(label AS INT) AS cluster_id, CAST(count(*) AS BIGINT) AS size, round(avg(sim), 6) AS cohesion, round(avg(vec_id), 6) AS centroid_x, arg_max(vec_id, sim) AS best FROM s GROUP BY label""")  # fmt: skip
def cluster_summaries(spark, sf_dir):
    rows = P.embeddings(spark, sf_dir).select("tile_id", "vector", F.col("label").alias("cluster_id"), F.col("tile_id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    out = clusters.summaries(rows)
    return out.select("cluster_id", "size", F.round("cohesion", 6).alias("cohesion"), F.round("centroid_x", 6).alias("centroid_x"), F.get("representative_tiles", F.lit(0)).alias("best"))


@register("cluster_neighbours", """SELECT a.vec_id AS a, CAST(count(*) AS BIGINT) AS n FROM embeddings a JOIN embeddings b ON 1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) <= 0.65 GROUP BY a.vec_id""")
def cluster_neighbours(spark, sf_dir):
    return clusters.neighbour_counts(P.embeddings(spark, sf_dir), 0.65)


def _near(eps: float) -> str:
    dot = lambda a, b: f"list_dot_product(CAST({a}.embedding AS DOUBLE[]), CAST({b}.embedding AS DOUBLE[]))"
    return f"near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON 1 - {dot('a', 'b')} / sqrt({dot('a', 'a')} * {dot('b', 'b')}) <= {eps})"


@register("cluster_neighbours_near", f"WITH {_near(0.15)} SELECT a, CAST(count(*) AS BIGINT) AS n FROM near GROUP BY a")
def cluster_neighbours_near(spark, sf_dir):
    return clusters.neighbour_counts(P.embeddings(spark, sf_dir), 0.15)


#: Customers as directions in space, by their keys.
POINTS = "points AS (SELECT c_custkey AS id, CAST(c_custkey * 7919 % 2001 - 1000 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 2003 - 1001 AS DOUBLE) AS y, CAST(c_custkey * 1299709 % 1999 - 999 AS DOUBLE) AS z FROM customer)"


def _directions(spark, sf_dir):
    k = F.col("c_custkey").cast("long")
    return P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tile_id"), F.array((k * 7919 % 2001 - 1000).cast("double"), (k * 104729 % 2003 - 1001).cast("double"), (k * 1299709 % 1999 - 999).cast("double")).alias("vector"))


@register("cluster_neighbours_directions", f"""WITH {POINTS}
SELECT a.id AS a, CAST(count(*) AS BIGINT) AS n FROM points a JOIN points b ON 1 - (a.x * b.x + a.y * b.y + a.z * b.z) / sqrt((a.x * a.x + a.y * a.y + a.z * a.z) * (b.x * b.x + b.y * b.y + b.z * b.z)) <= 0.002 GROUP BY a.id""")
def cluster_neighbours_directions(spark, sf_dir):
    """In few dimensions, where pivots tell vectors apart."""
    return clusters.neighbour_counts(_directions(spark, sf_dir), 0.002)


@register("cluster_join_work")
def cluster_join_work(spark, sf_dir):
    """What the radius joins of the three queries compare and copy."""
    rows = [("embeddings", 0.65, P.embeddings(spark, sf_dir)), ("embeddings", 0.15, P.embeddings(spark, sf_dir)), ("directions", 0.002, _directions(spark, sf_dir))]
    out = None
    for name, eps, members in rows:
        work = clusters.join_work(members, eps).select(F.lit(name).alias("members"), F.lit(eps).alias("eps"), "n", "pairs", "pivot_pairs", "copies", (F.col("pairs") / (F.col("n") * F.col("n"))).alias("share_of_all_pairs"))
        out = work if out is None else out.unionByName(work)
    return out


@register("cluster_dbscan_labels", f"""WITH RECURSIVE {_near(0.65)},
core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 4),
linked AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT a, a AS root FROM core UNION SELECT l.b, r.root FROM reach r JOIN linked l ON l.a = r.a),
label AS (SELECT a, min(root) AS root FROM reach GROUP BY a),
border AS (SELECT n.a, min(l.root) AS root FROM near n JOIN label l ON l.a = n.b GROUP BY n.a),
ids AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster_id FROM (SELECT DISTINCT root FROM label))
SELECT vec_id AS tile_id, CAST(coalesce(i.cluster_id, -1) AS INT) AS cluster_id, vec_id IN (FROM core) AS is_core FROM embeddings LEFT JOIN border ON border.a = vec_id LEFT JOIN ids i ON i.root = border.root""")
def cluster_dbscan_labels(spark, sf_dir):
    return clusters.dbscan_labels(P.embeddings(spark, sf_dir), 0.65, 4)


DENSE = f"""WITH RECURSIVE {_near(0.65).replace("SELECT a.vec_id AS a, b.vec_id AS b", "SELECT a.vec_id AS a, b.vec_id AS b, 1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS d")},
core AS (SELECT a, d AS c FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 2),
edge AS (SELECT near.a, near.b, greatest(d, x.c, y.c) AS w FROM near JOIN core x ON x.a = near.a JOIN core y ON y.a = near.b WHERE near.a < near.b)"""


@register("cluster_forest", f"""{DENSE},
e AS (SELECT *, row_number() OVER (ORDER BY w, a, b) AS k FROM edge),
twice AS (SELECT k, a, b FROM e UNION ALL SELECT k, b, a FROM e),
reach AS (SELECT k AS goal, a AS at FROM e UNION SELECT r.goal, s.b FROM reach r JOIN twice s ON s.a = r.at AND s.k < r.goal)
SELECT a, b, round(w, 6) AS weight FROM e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.goal = e.k AND r.at = e.b)""")
def cluster_forest(spark, sf_dir):
    """The minimum spanning forest of mutual reachability: an edge is in it if no smaller ones join its ends."""
    out = clusters.spanning_forest(clusters.reachability_edges(P.embeddings(spark, sf_dir), 0.65, 2))
    return out.select("a", "b", F.round("weight", 6).alias("weight"))


@register("cluster_levels", f"""{DENSE}, level(l, wider) AS (VALUES (0.6, 0.625), (0.625, 0.65), (0.65, NULL)),
s AS (SELECT l, a, b FROM edge JOIN level ON w <= l UNION ALL SELECT l, b, a FROM edge JOIN level ON w <= l),
reach AS (SELECT DISTINCT l, a, a AS root FROM s UNION SELECT r.l, s.b, r.root FROM reach r JOIN s ON s.l = r.l AND s.a = r.a),
label AS (SELECT l, a, min(root) AS root FROM reach GROUP BY l, a),
sized AS (SELECT l, wider, root, count(*) AS size FROM label JOIN level USING (l) GROUP BY ALL HAVING count(*) >= 3)
SELECT CAST(z.l AS DOUBLE) AS level, z.root, CAST(size AS BIGINT) AS size, p.root AS parent FROM sized z LEFT JOIN label p ON p.l = z.wider AND p.a = z.root""")
def cluster_levels(spark, sf_dir):
    """The clusters at three distances, and how they nest."""
    return clusters.density_levels(P.embeddings(spark, sf_dir), [0.6, 0.625, 0.65], 2, 3)


@register("cluster_noise", f"""WITH {_near(0.65)}, core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 4), held AS (SELECT DISTINCT a FROM near WHERE b IN (FROM core))
SELECT CAST(count(*) AS BIGINT) AS members, CAST(count(*) FILTER (vec_id NOT IN (FROM held)) AS BIGINT) AS noise, CAST(count(*) FILTER (vec_id IN (FROM core)) AS BIGINT) AS cores FROM embeddings""")
def cluster_noise(spark, sf_dir):
    labels = clusters.dbscan_labels(P.embeddings(spark, sf_dir), 0.65, 4)
    return clusters.label_counts(labels).select("members", "noise", "cores")


@register("review_targets", """WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS review_id, l_partkey AS result_id, l_suppkey AS query_id, CASE l_returnflag WHEN 'A' THEN 'accept' WHEN 'R' THEN 'reject' ELSE 'skip' END AS decision FROM lineitem)
SELECT review_id, CASE WHEN p.p_partkey % 3 <> 0 THEN 'search_result' WHEN p.p_partkey % 9 = 0 THEN 'change_analysis' END AS result_type, CASE WHEN p.p_partkey % 3 <> 0 THEN p.p_partkey % 10 ELSE query_id END AS query_id,
  CASE WHEN p.p_partkey % 3 <> 0 THEN p.p_size / 50.0 WHEN p.p_partkey % 9 = 0 THEN p.p_size / 100.0 END AS score, CASE WHEN p.p_partkey % 9 = 0 THEN p.p_brand END AS change_type,
  decision <> 'skip' AND coalesce(CASE WHEN p.p_partkey % 3 <> 0 THEN query_id = p.p_partkey % 10 ELSE p.p_partkey % 9 = 0 END, FALSE) AS valid
FROM r LEFT JOIN part p ON p.p_partkey = r.result_id""")
def review_targets(spark, sf_dir):
    """Reviews of parts: most are search results, a ninth change analyses, the others nothing."""
    decision = F.when(F.col("l_returnflag") == "A", F.lit("accept")).when(F.col("l_returnflag") == "R", F.lit("reject")).otherwise(F.lit("skip"))
    rows = P.table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("review_id"), F.col("l_partkey").alias("result_id"), F.col("l_suppkey").cast("long").alias("query_id"), decision.alias("decision"))
    part = P.table(spark, sf_dir, "part")
    results = part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("result_id"), (F.col("p_partkey") % 10).cast("long").alias("query_id"), (F.col("p_size") / 50.0).alias("final_score"), F.lit(None).cast("string").alias("change_analysis_id"))
    analyses = part.filter("p_partkey % 9 = 0").select(F.col("p_partkey").alias("analysis_id"), (F.col("p_size") / 100.0).alias("confidence"), F.col("p_brand").alias("change_type"))
    return review.resolve_targets(rows, results, analyses).select("review_id", "result_type", "query_id", "score", "change_type", "valid")


@register("review_queue_sensor", """SELECT CAST(o_orderkey AS VARCHAR) AS id, round(o_totalprice / 600000, 4) AS confidence FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def review_queue_sensor(spark, sf_dir):
    """Orders as analyses to review whose evidence has a tile of one sensor; line items are the evidence, their flags the sensors."""
    o, lines = P.table(spark, sf_dir, "orders"), P.table(spark, sf_dir, "lineitem")
    analyses = o.select(F.col("o_orderkey").cast("string").alias("analysis_id"), (F.col("o_totalprice") / 600000).alias("confidence"), F.lit("t").alias("change_type"), F.lit("pending_review").alias("status"), F.col("o_orderdate").alias("earliest_supported_time"))
    evidence = lines.select(F.col("l_orderkey").cast("string").alias("analysis_id"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("after_tile_id"))
    tiles = lines.select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("tile_id"), F.col("l_returnflag").alias("sensor"), F.col("l_shipdate").alias("acquisition_time"))
    results = spark.createDataFrame([], "result_id string, tile_id string, final_score double, status string")
    return review.review_queue(analyses, evidence, results, tiles, item_type="change_analysis", sensor="a").select("id", F.round("confidence", 4).alias("confidence"))


@register("change_evaluation", """WITH d AS (SELECT o_orderkey AS id, o_orderpriority AS t, o_orderdate AS day FROM orders WHERE o_orderkey % 2 = 0), k AS (SELECT l_orderkey AS id, CASE WHEN l_quantity > 25 THEN '1-URGENT' ELSE '2-HIGH' END AS t, l_shipdate AS day FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
h AS (SELECT d.t AS found, k.t AS known, CAST(floor((epoch(d.day) - epoch(k.day)) / 86400) AS BIGINT) AS lag FROM d JOIN k USING (id)), s AS (SELECT count(*) AS tp, count(*) FILTER (found = known) AS good, list_sort(list(lag)) AS lags FROM h), n AS (SELECT (SELECT count(*) FROM d) AS nd, (SELECT count(*) FROM k) AS nk)
SELECT nd AS n_detections, nk AS n_truth, tp, nd - tp AS fp, nk - tp AS fn, round(tp / nd, 6) AS precision, round(tp / nk, 6) AS recall, round(2 * (tp / nd) * (tp / nk) / (tp / nd + tp / nk), 6) AS f1, round(good / tp, 6) AS type_accuracy, CAST(lags[tp // 2 + 1] AS BIGINT) AS median_delay_days FROM s, n""")
def change_evaluation(spark, sf_dir):
    """Even orders as detections, first line items of every third order as known changes, matched by order."""
    o, lines = P.table(spark, sf_dir, "orders"), P.table(spark, sf_dir, "lineitem")
    d = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("det_id"), F.col("o_orderpriority").alias("change_type"), F.col("o_orderdate").cast("timestamp").alias("earliest_supported_time"))
    first = lines.filter("l_linenumber = 1 and l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("truth_id")).agg(F.min_by(F.struct("l_quantity", "l_shipdate"), F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("l"))
    t = first.select("truth_id", F.when(F.col("l.l_quantity") > 25, F.lit("1-URGENT")).otherwise(F.lit("2-HIGH")).alias("change_type"), F.col("l.l_shipdate").cast("timestamp").alias("date"))
    out = evaluation.change_metrics(d, t, d.select("det_id").join(t.select(F.col("truth_id").alias("det_id")), "det_id").withColumn("truth_id", F.col("det_id")))
    return out.select("n_detections", "n_truth", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "type_accuracy")], F.col("median_delay_days").cast("long").alias("median_delay_days"))


@register("cluster_kmeans")
def cluster_kmeans(spark, sf_dir):
    rows = P.embeddings(spark, sf_dir).select("tile_id", "vector", F.col("tile_id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    return clusters.discover(rows, "kmeans", n_clusters=10)


@register("cluster_dbscan")
def cluster_dbscan(spark, sf_dir):
    rows = P.embeddings(spark, sf_dir).select("tile_id", "vector", F.col("tile_id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    return clusters.discover(rows, "dbscan", eps=0.65, min_cluster_size=4)


TEMPLATES = ["newly built structures near a river", "flooding along the coast between 2019 and 2021", "deforestation since 2018", "new road inside the forest", "ships on water before 2020", "expanded mine", "quiet place", "demolished buildings by the lake from 2015"]
EXPECTED = [("construction", "near", None), ("water_extent_change", None, "2019-01-01"), ("clearance", None, "2018-01-01"), ("road_development,construction,appearance", "inside", None), ("", None, None), ("expansion", None, None), ("", None, None), ("disappearance", None, "2015-01-01")]


def _expected() -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'"
    return ", ".join(f"({k}, {text(t)}, {text(d)})" for k, (t, _, d) in enumerate(EXPECTED))


@register("query_parsing", f"SELECT o_orderkey AS query_id, x.types AS change_types, CAST(x.start AS DATE) AS date_from FROM orders JOIN (VALUES {_expected()}) x(k, types, start) ON o_orderkey % 8 = x.k")
def query_parsing(spark, sf_dir):
    templates = F.array(*map(F.lit, TEMPLATES))
    rows = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.get(templates, (F.col("o_orderkey") % 8).cast("int")).alias("text"))
    parsed = rows.join(parse_queries(rows.select("text").distinct()), "text")  # each text once
    return parsed.select("query_id", F.array_join("change_types", ",").alias("change_types"), F.to_date("date_from").alias("date_from"))


@register("scene_metadata", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Sentinel-2A' WHEN 1 THEN 'Sentinel-1B' WHEN 2 THEN 'Landsat-8' ELSE 'PlanetScope' END AS platform,
       CASE event_id % 4 WHEN 0 THEN 'MSI' WHEN 1 THEN 'C-SAR' WHEN 2 THEN 'OLI' ELSE 'PS' END AS sensor, CAST(ts AS DATE) AS day FROM events""")
def scene_metadata(spark, sf_dir):
    prefix = F.get(F.array(*map(F.lit, ("S2A_", "s1b_", "LC08_", "PS_"))), (F.col("event_id") % 4).cast("int"))
    rows = P.table(spark, sf_dir, "events").select("event_id", F.concat(prefix, F.date_format("ts", "yyyyMMdd"), F.lit(".tif")).alias("filename"))
    return files.with_metadata(rows).select("event_id", "platform", "sensor", F.to_date("acquisition_time").alias("day"))


@register("datetime_parsing", "SELECT event_id, CAST(CASE event_id % 3 WHEN 2 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS TIMESTAMP) AS t FROM events")
def datetime_parsing(spark, sf_dir):
    forms = [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(F.lit("acq "), F.date_format("ts", "yyyyMMdd'T'HHmmss")), F.concat(F.lit("x"), F.date_format("ts", "yyyy-MM-dd"))]
    text = F.get(F.array(*forms), (F.col("event_id") % 3).cast("int"))
    return P.table(spark, sf_dir, "events").select("event_id", parse_datetime(text).cast("timestamp_ntz").alias("t"))


@register("ingest_identity", "SELECT doc_id, 'scn_' || substr(sha256(text), 1, 20) AS scene_id, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS duplicate FROM documents")
def ingest_identity(spark, sf_dir):
    named = files.with_identity(P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content")))
    return named.select(F.col("path").alias("doc_id"), "scene_id", "duplicate")


@register("ingest_unchanged", "SELECT page_id FROM pages WHERE NOT (page_id % 2 = 0 AND page_id % 4 = 0)")
def ingest_unchanged(spark, sf_dir):
    pages = P.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.length("html").alias("size"), F.col("page_id").alias("mtime"))
    done = pages.filter("page_id % 2 = 0").withColumn("status", F.when(F.col("page_id") % 4 == 0, F.lit("complete")).otherwise(F.lit("failed")))
    return files.not_ingested(pages, done).select("page_id")


@register("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    out = activity_windows(P.table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
