"""Analyst review: queue, history, feedback statistics, hard negatives, training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISIONS = ("accept", "reject", "uncertain")
STATUS_FOR = {"accept": "accepted", "reject": "rejected", "uncertain": "uncertain"}


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last review of each result by time, then id; one aggregation, no sort of a result's history."""
    row = F.struct(*[c for c in reviews.columns if c != "result_id"])
    return reviews.groupBy("result_id").agg(F.max_by(row, F.struct("timestamp", "review_id")).alias("r")).select("result_id", "r.*")


def resolve_targets(reviews: DataFrame, results: DataFrame, analyses: DataFrame) -> DataFrame:
    """Reviews with the result or, failing that, the change analysis they are about; ``valid`` says whether there is one and the decision is known."""
    r = results.select(F.col("result_id"), F.col("query_id").alias("_query"), F.col("final_score").alias("_score"), F.col("change_analysis_id").alias("_linked"))
    a = analyses.select(F.col("analysis_id").alias("result_id"), F.col("confidence").alias("_confidence"), F.col("change_type").alias("_type"))
    out = reviews.join(r, "result_id", "left").join(a, "result_id", "left")
    is_result, is_change = F.col("_query").isNotNull(), F.col("_confidence").isNotNull()
    same_query = F.col("query_id").isNull() | ~is_result | (F.col("query_id") == F.col("_query"))
    return out.withColumns({
        "result_type": F.when(is_result, F.lit("search_result")).when(is_change, F.lit("change_analysis")),
        "query_id": F.coalesce("_query", "query_id"),
        "score": F.coalesce("_score", "_confidence"),
        "change_type": F.when(~is_result, F.col("_type")),
        "linked_analysis_id": F.col("_linked"),
        "valid": (is_result | is_change) & same_query & F.col("decision").isin(*DECISIONS),
    }).drop("_query", "_score", "_linked", "_confidence", "_type")


def with_status(items: DataFrame, id_col: str, reviews: DataFrame) -> DataFrame:
    """``items`` whose ``status`` follows their latest decision."""
    statuses = F.create_map(*[F.lit(x) for kv in STATUS_FOR.items() for x in kv])
    last = latest_reviews(reviews).select(F.col("result_id").alias(id_col), F.element_at(statuses, F.col("decision")).alias("_new"))
    return items.join(last, id_col, "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def review_queue(analyses: DataFrame, evidence: DataFrame, results: DataFrame, tiles: DataFrame, *, status: str = "pending_review", change_type: str | None = None, item_type: str | None = None,
                 min_confidence: float | None = None, max_confidence: float | None = None, date_from=None, date_to=None, sensor: str | None = None) -> DataFrame:
    """Items to review, those nearest to a score of 0.5 first; page with ``offset().limit()``."""
    parts = []
    if item_type in (None, "change_analysis"):
        part = analyses.select(F.lit("change_analysis").alias("item_type"), F.col("analysis_id").alias("id"), "confidence", "change_type", "status", F.col("earliest_supported_time").alias("time"))
        if sensor:
            seen = evidence.join(tiles.filter(F.lower("sensor") == sensor.lower()).select(F.col("tile_id").alias("after_tile_id")), "after_tile_id", "left_semi")
            part = part.join(seen.select(F.col("analysis_id").alias("id")), "id", "left_semi")
        parts.append(part)
    if item_type in (None, "search_result") and not change_type:
        of_tile = tiles.select("tile_id", "sensor", F.col("acquisition_time").alias("time"))
        part = results.join(of_tile, "tile_id")
        part = part.filter(F.lower("sensor") == sensor.lower()) if sensor else part
        parts.append(part.select(F.lit("search_result").alias("item_type"), F.col("result_id").alias("id"), F.col("final_score").alias("confidence"), F.lit(None).cast("string").alias("change_type"), "status", "time"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    tests = [(status != "all", F.col("status") == status), (change_type, F.col("change_type") == change_type), (min_confidence is not None, F.col("confidence") >= F.lit(min_confidence)),
             (max_confidence is not None, F.col("confidence") <= F.lit(max_confidence)), (date_from is not None, F.col("time") >= F.lit(date_from)), (date_to is not None, F.col("time") <= F.lit(date_to))]
    for used, test in tests:
        out = out.filter(test) if used else out
    return out.orderBy(F.abs(F.coalesce("confidence", F.lit(0.0)) - 0.5), F.col("id").cast("string"))


def review_history(reviews: DataFrame, *, result_id: str | None = None, query_id: str | None = None, analyst_id: str | None = None, decision: str | None = None, date_from=None, date_to=None) -> DataFrame:
    out = reviews
    for name, value in (("result_id", result_id), ("query_id", query_id), ("analyst_id", analyst_id), ("decision", decision)):
        out = out.filter(F.col(name) == value) if value is not None else out
    out = out.filter(F.col("timestamp") >= F.lit(date_from)) if date_from is not None else out
    out = out.filter(F.col("timestamp") <= F.lit(date_to)) if date_to is not None else out
    return out.orderBy(F.desc("timestamp"), F.desc("review_id"))


def _decisions() -> list:
    accept, reject = F.count_if(F.col("decision") == "accept"), F.count_if(F.col("decision") == "reject")
    return [accept.alias("accept"), reject.alias("reject"), F.count_if(F.col("decision") == "uncertain").alias("uncertain"), (accept / F.nullif(accept + reject, F.lit(0))).alias("precision")]


def decision_counts(latest: DataFrame, *by) -> DataFrame:
    """Counts of the decisions and the precision (null without accepts and rejects), by ``by``."""
    return latest.groupBy(*by).agg(*_decisions())


def score_bucket(score):
    """The tenth a score is in, as "0.3-0.4"; 1 and more count to the last."""
    low = F.least(F.floor(score * 10), F.lit(9)).cast("int")
    return F.format_string("%.1f-%.1f", low / 10.0, (low + 1) / 10.0)


def by_change_type(latest: DataFrame) -> DataFrame:
    rows = latest.filter(F.col("result_type") == "change_analysis").withColumn("change_type", F.coalesce("change_type", F.lit("unknown")))
    return decision_counts(rows, "change_type")


def calibration(latest: DataFrame) -> DataFrame:
    return decision_counts(latest.filter("score is not null").withColumn("bucket", score_bucket(F.col("score"))), "bucket")


def conflicting(reviews: DataFrame) -> DataFrame:
    """Results with reviews of different decisions."""
    return reviews.groupBy("result_id").agg(F.count("*").alias("reviews"), F.min("decision").alias("a"), F.max("decision").alias("b")).filter("reviews > 1 and a <> b").select("result_id", "reviews")


def totals(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count("*").alias("total_reviews"), F.countDistinct("result_id").alias("reviewed_items"), F.countDistinct("analyst_id").alias("analysts"), F.countDistinct("query_id").alias("queries_reviewed"))


def hard_negatives(latest: DataFrame, queries: DataFrame | None = None, min_score: float = 0.5, limit: int = 1000) -> DataFrame:
    """Rejected results that scored high, the highest first."""
    rows = latest.filter((F.col("decision") == "reject") & (F.col("score") >= min_score))
    rows = rows.orderBy(F.desc("score"), "result_id").limit(limit)
    return rows if queries is None else rows.join(queries.select("query_id", "query_text"), "query_id", "left")


def training_rows(latest: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, tile, label) of the latest reviews of search results."""
    rows = latest.filter(F.col("result_type") == "search_result").withColumnRenamed("decision", "label")
    return rows.join(queries.select("query_id", "query_text", "query_type", "embedding_model"), "query_id", "left")
