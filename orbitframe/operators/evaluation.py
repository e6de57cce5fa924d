"""Retrieval metrics by query, and change detection against known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.polygons import edges, edges_meet
from ..session import cut


def _ideal(n: Column) -> Column:
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))).otherwise(F.lit(0.0))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """Precision, recall and binary NDCG at each k and the reciprocal rank, one row a query with relevant items.

    ``ranked(query_id, item_id, rank)`` with ranks from 1; ``relevant(query_id, item_id)``.
    """
    wanted = relevant.select("query_id", "item_id").distinct()
    total = wanted.groupBy("query_id").agg(F.count("*").cast("int").alias("n_relevant"))
    rows = ranked.join(wanted.withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left").filter("hit = 1")
    aggregates = [F.min("rank").alias("first")]
    for k in ks:
        inside = F.col("rank") <= k
        aggregates += [F.count_if(inside).alias(f"hits_{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}")]
    out = total.join(rows.groupBy("query_id").agg(*aggregates), "query_id", "left")
    cols = []
    for k in ks:
        hits, n = F.coalesce(f"hits_{k}", F.lit(0)), F.col("n_relevant")
        cols += [(hits / k).alias(f"precision_{k}"), (hits / n).alias(f"recall_{k}"), (F.coalesce(f"dcg_{k}", F.lit(0.0)) / _ideal(F.least(n, F.lit(k)))).alias(f"ndcg_{k}")]
    return out.select("query_id", "n_relevant", *cols, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def macro_average(metrics: DataFrame) -> DataFrame:
    values = [c for c in metrics.columns if c not in ("query_id", "n_relevant")]
    return metrics.agg(F.count("*").alias("queries_evaluated"), *[F.avg(c).alias(c) for c in values])


def judged_by_reviews(latest: DataFrame) -> DataFrame:
    """Relevant items from reviews: the accepted results of each query."""
    return latest.filter((F.col("decision") == "accept") & F.col("query_id").isNotNull()).select("query_id", F.col("result_id").alias("item_id"))


BOX = ("min_x", "min_y", "max_x", "max_y")


def _celled(df: DataFrame, prefix: str, cell: float) -> DataFrame:
    """A row for each grid cell that the box touches, columns prefixed."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    out = df.withColumn("cx", F.explode(span("min_x", "max_x"))).withColumn("cy", F.explode(span("min_y", "max_y")))
    return out.select("cx", "cy", *[F.col(c).alias(prefix + c) for c in df.columns])


#: Rows of a shape that are dealt out together.
SHAPE_ROWS = 1024


def _met_boxes(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """The pairs whose boxes meet, by grid cells (an equality join), each pair in the first cell that both touch only."""
    met = _celled(left, "l_", cell).join(_celled(right, "r_", cell), ["cx", "cy"])
    first = lambda c: F.floor(F.greatest(f"l_{c}", f"r_{c}") / cell)
    boxes = (F.col("l_min_x") <= F.col("r_max_x")) & (F.col("l_max_x") >= F.col("r_min_x")) & (F.col("l_min_y") <= F.col("r_max_y")) & (F.col("l_max_y") >= F.col("r_min_y"))
    return met.filter(boxes & (F.col("cx") == first("min_x")) & (F.col("cy") == first("min_y"))).drop("cx", "cy")


def _by_shape(df: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(shapes with their number ``s`` and edges, blocks of the rows of a shape as an array ``rows``), columns of the blocks prefixed."""
    shape = [*BOX, "rings"]
    counted = df.groupBy(*shape).agg(F.count("*").alias("n")).filter("rings is not null")
    shapes = cut(counted.withColumn("s", F.monotonically_increasing_id()))  # a number for each shape, fixed by the cut
    rest = [c for c in df.columns if c not in shape]
    dealt = df.join(shapes, shape).withColumn("p", F.pmod(F.xxhash64(*rest), F.ceil(F.col("n") / SHAPE_ROWS)) if rest else F.lit(0))
    blocks = dealt.groupBy("s", "p").agg(F.collect_list(F.struct(F.lit(0).alias("_"), *[F.col(c).alias(prefix + c) for c in rest])).alias("rows"))  # some SHAPE_ROWS rows
    return shapes.withColumn("edges", edges(F.col("rings"))).drop("n"), blocks.select(*[F.col(c).alias(prefix + c) for c in blocks.columns])


def _met_polygons(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """The pairs whose polygons meet. Each pair of different shapes is looked at once; their rows are paired by blocks, which are dealt out over all tasks."""
    (l_shapes, l_blocks), (r_shapes, r_blocks) = _by_shape(left, "l_"), _by_shape(right, "r_")
    met = _met_boxes(l_shapes, r_shapes, cell)
    met = cut(met.filter(edges_meet(F.col("l_edges"), F.col("r_edges"))).drop("l_edges", "r_edges"))
    met = met.join(l_blocks, "l_s").join(r_blocks, "r_s").repartition("l_s", "l_p", "r_s", "r_p")
    shape = [side + c for side in ("l_", "r_") for c in (*BOX, "rings")]
    rows = met.select(*shape, "r_rows", F.explode("l_rows").alias("l")).select(*shape, "l", F.explode("r_rows").alias("r"))
    of = lambda side, df: [F.col(f"{side}_{c}") if c in (*BOX, "rings") else F.col(f"{side}.{side}_{c}") for c in df.columns]
    return rows.select(*of("l", left), *of("r", right))


def meeting(left: DataFrame, right: DataFrame, cell: float = 1.0) -> DataFrame:
    """The pairs that meet, columns prefixed ``l_`` and ``r_``, once for each pair of rows: boxes, or where both sides have ``rings``, polygons in them."""
    shaped = "rings" in left.columns and "rings" in right.columns
    return _met_polygons(left, right, cell) if shaped else _met_boxes(left, right, cell)


def match_truth(detections: DataFrame, truth: DataFrame, cell: float = 1.0) -> DataFrame:
    """``(det_id, truth_id)``, one to one: detections in order of certainty take the first free truth they meet.

    Shapes are boxes, or where both tables have ``rings``, polygons in them.

    Detections with the same shapes are a class, and shapes meet truths in grid cells (an equality join), so pairs are of
    classes and truths. The k-th most certain detection of a class can have the k-th truth of its list at the earliest,
    and starts there. In each round every detection asks for the truth at its place; a truth asked by detections of several classes keeps
    the most certain one, the others go on by a place, and those behind them in their class stay behind them. A place never passes
    what the detection gets in the end, so when nobody has to go on, the matching is that of one detection after another.
    There is no limit of rounds: each one that isn't the last moves a place, and lists are finite.
    Repeated rows of an id are one detection with all their boxes and the highest certainty; rows with a null id are left out.
    ``detections(det_id, confidence, min_x, ...)``, ``truth(truth_id, min_x, ...)``.
    """

    shape = [*BOX, "rings"] if "rings" in detections.columns and "rings" in truth.columns else list(BOX)
    found = detections.filter("det_id is not null").groupBy("det_id").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set(F.struct(*shape))).alias("boxes"))
    classes = cut(found.select("boxes").distinct().withColumn("class", F.monotonically_increasing_id()))  # a number for each class, fixed by the cut
    boxes = classes.select("class", F.explode("boxes").alias("b")).select("class", "b.*")
    met = meeting(boxes, truth.filter("truth_id is not null").select("truth_id", *shape), cell)
    pairs = met.select(F.col("l_class").alias("class"), F.col("r_truth_id").alias("truth_id")).distinct()
    listed = cut(pairs.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("truth_id"))))
    lengths = listed.groupBy("class").agg(F.count("*").alias("length"))

    certain = [F.negative("confidence").asc_nulls_last(), F.col("det_id")]
    rows = found.join(classes, "boxes").select("det_id", "confidence", "class").join(lengths, "class")
    # only the first detections of a class, as many as its truths, can get one: first those of each of 64 parts, so that no task ranks a whole class
    rows = rows.withColumn("part", F.pmod(F.xxhash64("det_id"), F.lit(64)))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("class", "part").orderBy(*certain))).filter("k <= length").drop("part")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy(*certain))).filter("k <= length")
    asking = cut(rows.withColumn("place", F.col("k")))
    ahead = Window.partitionBy("class").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        asked = asking.join(listed, ["class", "place"])
        asked = cut(asked.withColumn("lost", (F.row_number().over(Window.partitionBy("truth_id").orderBy(*certain)) > 1).cast("int")))
        if asked.filter("lost = 1").isEmpty():
            return asked.select("det_id", "truth_id")
        moved = asked.withColumn("place", F.col("k") + F.max(F.col("place") + F.col("lost") - F.col("k")).over(ahead))
        asking = moved.filter("place <= length").select(*asking.columns)


def change_metrics(detections: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, F1, the share of right types, and the upper median of the delay in days."""
    d = detections.select("det_id", F.col("change_type").alias("found"), "earliest_supported_time")
    t = truth.select("truth_id", F.col("change_type").alias("known"), "date")
    hits = matches.join(d, "det_id").join(t, "truth_id")
    delay = F.floor((F.unix_timestamp("earliest_supported_time") - F.unix_timestamp("date")) / 86400)
    stats = hits.withColumn("delay", delay).agg(F.count("*").alias("tp"), F.count_if(F.col("found") == F.col("known")).alias("right"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY delay DESC)").alias("median_delay_days"))
    sizes = detections.agg(F.count("*").alias("n_detections")).crossJoin(truth.agg(F.count("*").alias("n_truth")))
    out = stats.crossJoin(sizes)  # one row each
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = out.withColumns({"fp": F.col("n_detections") - F.col("tp"), "fn": F.col("n_truth") - F.col("tp"), "precision": safe(F.col("tp"), F.col("n_detections")), "recall": safe(F.col("tp"), F.col("n_truth"))})
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    return out.select("n_detections", "n_truth", "tp", "fp", "fn", "precision", "recall", F.coalesce(f1, F.lit(0.0)).alias("f1"), (F.col("right") / F.nullif(F.col("tp"), F.lit(0))).alias("type_accuracy"), "median_delay_days")
