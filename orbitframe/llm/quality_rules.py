"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams.

DataFrame expressions only. Two multinomials over ``2**BITS`` hashed word unigrams
and bigrams are counted: one of the trusted target (all documents labelled good), one of the raw
corpus (all documents). To learn which documents are trusted, their ids are broadcast if a count shows few enough
(``runtime.sized``); otherwise ids and buckets of n-grams (two bytes each) are shuffled, never texts. A document's score is the sum of ln(p_target / p_raw) over its n-grams,
divided by their number. A document that the base rules keep is kept if its score is at least
``THRESHOLD``. Both tables have a fixed size; counting is pre-aggregated in each task
before the shuffle, and scoring is a map over the documents.

Defined results: null and empty texts have zero counts, score 0, and fail the base rules.
Repeated rows count and are judged each, and so are rows with a null id, which stays null (and isn't trusted). A doc_id with several labels is trusted if one of
them says so. Without trusted documents both multinomials are uniform in effect: every score is
0 and the base rules decide. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .runtime import documents, let, require, sized, table

BITS = 14
SMOOTHING = 1.0
THRESHOLD = -0.06
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
PACKED_BITS = 12


def _position_bits(n: Column) -> Column:
    return F.length(F.conv(n.cast("string"), 10, 2))


def repeated_words(hashed: Column) -> Column:
    """How many words are in a run of three words that occurs twice or more in the text.

    The runs' hashes are sorted with their places, so that equal runs lie side by side. In texts of less than ``2**PACKED_BITS`` words both are packed
    in one number (as many low bits as places need, the rest hash); longer ones would leave too few bits, and sort structs of two 64-bit hashes and the place.
    """
    places = lambda h: F.sequence(F.lit(0), F.size(h) - 3)
    run = lambda h, i, *seed: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2), *seed)
    covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

    def twice(a: Column, key) -> Column:
        return F.filter(a, lambda x, i: (key(F.get(a, i)) == key(F.get(a, i + 1))) | ((i > 0) & (key(F.get(a, i)) == key(F.get(a, F.greatest(i - 1, F.lit(0)))))))

    def short(h: Column) -> Column:
        packed = lambda b: F.transform(places(h), lambda i: F.call_function("shiftleft", run(h, i), b).bitwiseOR(i.cast("long")))
        key = lambda b: lambda x: F.call_function("shiftrightunsigned", x, b)
        place = lambda x, b: (x - F.call_function("shiftleft", F.call_function("shiftrightunsigned", x, b), b)).cast("int")
        return let(_position_bits(F.size(h)), lambda b: let(F.sort_array(packed(b)), lambda a: covered(F.transform(twice(a, key(b)), lambda x: place(x, b)))))

    def long(h: Column) -> Column:
        runs = F.transform(places(h), lambda i: F.struct(run(h, i).alias("x"), run(h, i, F.lit(1)).alias("y"), i.alias("at")))
        return let(F.sort_array(runs), lambda a: covered(F.transform(twice(a, lambda x: F.struct(x["x"], x["y"])), lambda x: x["at"])))

    return F.when(F.size(hashed) < 3, F.lit(0)).when(F.size(hashed) < 1 << PACKED_BITS, let(hashed, short)).otherwise(let(hashed, long)).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(W.SPACES)) != "")
    return F.when(F.contains(text, F.lit("\n")), let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))).otherwise(F.lit(0)).cast("long")


def ngram_buckets(hashed: Column) -> Column:
    """Buckets of the text's word unigrams and bigrams."""
    mask = F.lit((1 << BITS) - 1).cast("long")
    both = let(hashed, lambda h: F.concat(F.transform(h, lambda x: x.bitwiseAND(mask).cast("int")), F.transform(F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda x, i: F.xxhash64(F.get(h, i), x).bitwiseAND(mask).cast("int"))))
    return F.when(F.size(hashed) > 0, both).otherwise(F.array().cast("array<int>"))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """ln(p_target / p_raw) of each bucket, smoothed: the raw counts of all documents, the target's of all ``trusted`` ones."""
    buckets = docs.select("doc_id", ngram_buckets(W.hashes(W.words(F.col("text")))).cast("array<smallint>").alias("buckets"))
    rows = buckets.join(sized(trusted.select("doc_id", F.lit(1).alias("trusted"))), "doc_id", "left")
    grams = rows.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode_outer("buckets").alias("bucket"))
    counted = grams.filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target")).collect()  # 2**BITS rows at most
    size = 1 << BITS
    raw, target = [SMOOTHING] * size, [SMOOTHING] * size
    for r in counted:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if sum(target) == SMOOTHING * size:
        return [0.0] * size
    shift = math.log(sum(raw) / sum(target))
    return [math.log(t / r) + shift for t, r in zip(target, raw, strict=True)]


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: base counts, ``base_failed``, ``score`` and ``kept``."""
    docs = require(docs, "doc_id", "text")
    trusted = require(labels, "doc_id", "quality").filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    # a literal of fixed size: a text that the optimizer folds into one array
    ratios = F.split(F.lit(",".join(map(repr, log_ratios(docs, trusted)))), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t"), W.words(text).alias("w")).select("doc_id", "t", "w", W.hashes(F.col("w")).alias("h"))
    grams = ngram_buckets(F.col("h"))
    score = let(grams, lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(ratios, b)) / F.size(g)).otherwise(F.lit(0.0)))
    rows = rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("t", r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        repeated_lines(F.col("t")).alias("n_dup_lines"),
        repeated_words(F.col("h")).alias("n_repeat_words"),
        score.alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
