"""Benchmark decontamination: SimHash of item-sized windows, multi-index search, exact check.

DataFrame expressions only. For every benchmark item, windows of the item's
number of words are compared with it:

1. *Windows.* A window that passes the exact check shares a shingle with the
   item, so windows are laid wherever a document's shingle is one of an item's,
   aligned with the item. The shingles of the documents meet those of the benchmark in a
   hash join; the benchmark's side is broadcast only if it is at most
   ``BROADCAST_SHINGLES`` rows, and shuffled otherwise. Nothing else of a document is moved.
2. *Fingerprints.* Windows and items get 64-bit SimHashes of their words. The bits are cut
   into ``BLOCKS`` wide blocks: of fingerprints within the radius, one block at least differs in
   ``RADIUS / BLOCKS`` bits at most. Items are indexed by all values so close to their blocks', so an equality join on
   (item size, block, value) finds them all, and unrelated ones meet in less than one of a hundred cases.
3. *Rarest shingles.* The check weighs shingles and fingerprints don't, so a window that passes can lie at any
   distance, and no radius finds all. Such a window lacks at most ``1 - SIMILARITY`` of the item's weight, so it has one of
   the item's heaviest shingles that together exceed this share. An equality join of windows' shingles with these
   adds all pairs that the fingerprints miss: no laid window that passes the check is lost.
4. *Exact check.* A candidate counts if the item's shingles found in the window carry at
   least 0.8 of the weight of all its shingles. A shingle weighs one over the number of items
   that have it. Shingles have five words (an item of fewer words is one shingle).

Defined results: null, empty and wordless texts and items are never contaminated or
matched. A text shorter than an item is one window. Repeated rows of a doc_id are judged
together, repeated items too. Rows with a null id are left out. Empty tables give an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .runtime import cut, documents, let, require, sized, table, with_row

WIDTH = 5
SIMILARITY = 0.8
BITS = 64
BLOCKS, RADIUS = 4, 11
BROADCAST_SHINGLES = 1_000_000
BROADCAST_WINDOWS = 1_000_000


def _bit(value: Column, at: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, at).bitwiseAND(F.lit(1).cast("long"))


def simhash(hashed: Column) -> Column:
    """The 64-bit SimHash of hashed words: each bit as most words have it."""
    votes = lambda h, b: F.aggregate(h, F.lit(0).cast("long"), lambda acc, w: acc + _bit(w, b))
    bit = lambda h, b: F.when(votes(h, b) * 2 > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return let(hashed, lambda h: F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(h, b))))


def blocks(fingerprint: Column) -> Column:
    """``BLOCKS`` structs (block, value) that cover all bits."""
    width = BITS // BLOCKS
    mask = F.lit((1 << width) - 1).cast("long")
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, k * width).bitwiseAND(mask).alias("value")) for k in range(BLOCKS)])


def probes(fingerprint: Column, radius: int = RADIUS) -> Column:
    """The blocks, and all values that differ from one of them in ``radius // BLOCKS`` bits at most."""
    flips = [sum(1 << b for b in bits) for n in range(radius // BLOCKS + 1) for bits in combinations(range(BITS // BLOCKS), n)]
    near = lambda x: F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda f: F.struct(x["block"].alias("block"), x["value"].bitwiseXOR(f).alias("value")))
    return F.flatten(F.transform(blocks(fingerprint), near))


def _hashed(df: DataFrame, id_col: str) -> DataFrame:
    """(id, h): hashed lower-case words of each text."""
    return require(df, id_col, "text").filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), W.hashes(W.words(F.lower("text"))).alias("h"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, item_id, start_word, n_words, distance, similarity)``: the best window of each document and item that match."""
    items = _hashed(benchmark, "item_id").filter(F.size("h") > 0).withColumn("n", F.size("h")).withColumn("width", F.least("n", F.lit(WIDTH)))
    wide = {k: F.col("width") == k for k in range(1, WIDTH + 1)}
    own = F.coalesce(*[F.when(is_k, W.shingles(F.col("h"), k)) for k, is_k in wide.items()])
    items = cut(items.select(F.col("id").alias("item_id"), "n", "width", own.alias("own"), simhash(F.col("h")).alias("item_print")))
    places = items.select("item_id", "n", "width", F.posexplode("own").alias("j", "s"))
    weights = places.select("item_id", "s").distinct().groupBy("s").agg((1 / F.count("*")).alias("w"))
    weighed = places.select("item_id", "s").distinct().join(weights, "s").groupBy("item_id").agg(F.collect_list(F.struct("s", "w")).alias("parts"), F.sum("w").alias("total"))

    widths = [r.width for r in items.select("width").distinct().collect()]  # WIDTH values at most
    seeds = places.select("s", "width", "j", F.col("n").alias("len")).distinct()
    if seeds.count() <= BROADCAST_SHINGLES:
        seeds = F.broadcast(seeds)
    hashed = _hashed(docs, "doc_id")
    met = None
    for k in widths:
        # the outer form keeps the optimizer from computing the shingles once more for a filter; null ones don't join
        rows = hashed.select("id", F.size("h").alias("size"), F.posexplode_outer(W.shingles(F.col("h"), k)).alias("at", "s"))
        rows = rows.join(seeds.filter(F.col("width") == k).drop("width"), "s").select("id", "len", F.greatest(F.lit(0), F.least(F.col("at") - F.col("j"), F.col("size") - F.col("len"))).alias("start"))
        met = rows if met is None else met.unionAll(rows)
    if met is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start_word int, n_words int, distance int, similarity double")
    windows = cut(met.distinct())
    laid_in = windows.groupBy("id").agg(F.collect_list(F.struct("start", "len")).alias("windows"))
    # a document here has one window at least, so their number bounds this side too
    laid_in = F.broadcast(laid_in) if windows.count() <= BROADCAST_WINDOWS else laid_in

    # the windows' words, from the texts once more: only texts with windows are cut into words
    texts = require(docs, "doc_id", "text").withColumn("id", F.col("doc_id").cast("long")).join(laid_in, "id")
    texts = texts.select("id", "windows", W.hashes(W.words(F.lower("text"))).alias("h"))
    window = lambda w: F.struct(w["start"].alias("start"), w["len"].alias("len"), F.slice("h", w["start"] + 1, w["len"]).alias("h"))
    laid = texts.select(F.col("id"), F.explode(F.transform("windows", window)).alias("w")).select("id", "w.*")
    laid = cut(laid.filter(F.size("h") > 0).withColumn("print", simhash(F.col("h"))))
    asked = laid.select("id", "start", "len", "print", F.explode(blocks(F.col("print"))).alias("b")).select("id", "start", "len", "print", "b.*")
    index = items.select("item_id", F.col("n").alias("len"), "item_print", F.explode(probes(F.col("item_print"), radius)).alias("b")).select("item_id", "len", "item_print", "b.*")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = asked.join(index, ["len", "block", "value"]).withColumn("distance", distance).filter(F.col("distance") <= radius)
    # item's shingles from the heaviest on, until they weigh more than a passing window can lack
    heavier = Window.partitionBy("item_id").orderBy(F.desc("part.w"), "part.s").rowsBetween(Window.unboundedPreceding, -1)
    parts = weighed.select("item_id", "total", F.explode("parts").alias("part"))
    lead = parts.withColumn("before", F.coalesce(F.sum("part.w").over(heavier), F.lit(0.0))).filter(F.col("before") <= (1 - similarity) * F.col("total") + 1e-9)
    lead = lead.select("item_id", F.col("part.s").alias("s")).join(items.select("item_id", F.col("n").alias("len"), "item_print").distinct(), "item_id")
    held = laid.select("id", "start", "len", "print", F.explode(F.array_distinct(F.coalesce(*[F.when(F.least("len", F.lit(WIDTH)) == k, W.shingles(F.col("h"), k)) for k in wide]))).alias("s"))
    rare = held.join(lead, ["len", "s"]).withColumn("distance", distance)
    near = near.select("id", "start", "len", "item_id", "distance").unionAll(rare.select("id", "start", "len", "item_id", "distance")).distinct()
    checked = near.join(laid.select("id", "start", "len", "h"), ["id", "start", "len"]).join(weighed, "item_id").join(items.select("item_id", "width").distinct(), "item_id")
    inside = F.coalesce(*[F.when(is_k, W.shingles(F.col("h"), k)) for k, is_k in wide.items()])
    shared = let(inside, lambda s: F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + F.when(F.array_contains(s, p["s"]), p["w"]).otherwise(0.0)))
    checked = checked.withColumn("similarity", shared / F.col("total")).filter(F.col("similarity") >= similarity - 1e-12)
    best = checked.groupBy("id", "item_id").agg(F.max_by(F.struct("start", "len", "distance", "similarity"), F.struct(F.round("similarity", 9), F.negative("start"))).alias("b"))
    return best.select(F.col("id").alias("doc_id"), "item_id", F.col("b.start").alias("start_word"), F.col("b.len").alias("n_words"), F.col("b.distance").cast("int").alias("distance"), F.col("b.similarity").alias("similarity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches without the fingerprints' distance, which SQL can't tell."""
    found = decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 6).alias("similarity"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that hold a benchmark item go, whatever their ids."""
    rows = with_row(docs)
    bad = decontaminate(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(sized(bad), "_row", "left_anti").select(*docs.columns)
