"""Chat formatting: quotation linking.

DataFrame expressions only.

1. *Parse.* Lines that begin with ``>`` marks are quoted, as many levels deep as there are marks; runs of lines of
   one level are passages. A line such as "On Monday Ann wrote:" right before a quotation belongs to it.
2. *Hash.* The message's own text is hashed as a whole, by run between quotations and by line; quoted passages are
   hashed by run and by line. Case, white space and punctuation don't count.
3. *Join.* Hashes of quotations meet those of own text within the conversation. Of messages that hold
   the same text the first is its origin. (conversation, hash) pairs are reduced to the smallest turn before they
   meet, so a common line makes one row, not pairs.
4. *Order.* A message replies to the earlier message of whose text it quotes most at level one (ties:
   the later). Messages that quote nothing known begin a thread. ``thread`` holds the turns from the thread's begin to the
   message, each as sixteen hexadecimal digits (the sign bit flipped, so negative turns come first): in its order replies follow what they answer. Threads are
   completed by pointer doubling, in as many joins as the logarithm of the deepest one.

Messages stay rows of their own (sorting by ``conv_id, thread`` gives the conversation); none is gathered
with others, so one conversation may hold any share of all rows.

Defined results: null and empty texts give an empty ``clean_text`` and quote nothing. Rows
with a null ``conv_id`` or ``turn`` are left out. Repeated (conv_id, turn) rows stay, and
are treated as one message in linking. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, let, require, spread_join, table

MARKS = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"(?i)^\s*(?:on\b.*|.{1,80}) wrote:\s*$"
MIN_QUOTED = 2
ROUNDS = 40


def parsed(text: Column) -> Column:
    """Lines as ``struct<level, body>``."""
    line = lambda x: let(F.regexp_extract(x, MARKS, 0), lambda m: F.struct(F.length(F.regexp_replace(m, "[^>]", "")).alias("level"), F.when(m == "", x).otherwise(F.ltrim(F.substring(x, F.length(m) + 1, F.length(x)))).alias("body")))
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), line)
    introduces = lambda a, x, i: (x["level"] == 0) & x["body"].rlike(ATTRIBUTION) & (F.coalesce(F.get(a, i + 1)["level"], F.lit(0)) > 0)
    return let(lines, lambda a: F.filter(a, lambda x, i: ~introduces(a, x, i)))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def runs(lines: Column) -> Column:
    """Runs of lines of one level as ``struct<level, body>``, the lines joined by spaces; each line is copied once."""
    level = lambda a, i: F.get(a, i)["level"]
    starts = lambda a: F.filter(F.transform(a, lambda _, i: F.when((i == 0) | (level(a, i) != level(a, i - 1)), i)), lambda i: i.isNotNull())
    body = lambda a, first, last: F.array_join(F.transform(F.slice(a, first + 1, last - first), lambda x: x["body"]), " ")
    run = lambda a, s: F.transform(s, lambda first, k: F.struct(level(a, first).alias("level"), body(a, first, F.coalesce(F.get(s, k + 1), F.size(a))).alias("body")))
    return let(lines, lambda a: let(starts(a), lambda s: run(a, s)))


def link_quotes(conversations: DataFrame) -> DataFrame:
    """One row a message: ``conv_id, turn, role, parent_turn, depth, thread, n_quoted, n_linked, clean_text``."""
    rows = require(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null and turn is not null")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", parsed(F.col("text")).alias("lines"))
    rows = rows.select("conv_id", "turn", "role", "lines", runs(F.col("lines")).alias("runs"))
    own = F.filter("lines", lambda x: x["level"] == 0)
    clean = F.regexp_replace(F.trim(F.array_join(F.transform(own, lambda x: x["body"]), "\n")), r"\n{3,}", "\n\n")
    whole = F.array_join(F.transform(own, lambda x: x["body"]), " ")
    rows = cut(rows.select(
        "conv_id", "turn", "role", clean.alias("clean_text"),
        F.array_distinct(F.transform(F.concat(F.array(whole), F.transform(F.filter("runs", lambda x: x["level"] == 0), lambda x: x["body"]), F.transform(own, lambda x: x["body"])), normalised)).alias("own"),
        F.transform(F.filter("runs", lambda x: x["level"] > 0), lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("body"))).alias("passages"),
        F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("body"))).alias("quoted"),
    ))
    asked = rows.select("conv_id", "turn", F.explode(F.array_distinct(F.concat("passages", "quoted"))).alias("q")).filter(F.length("q.body") >= MIN_QUOTED)
    asked = asked.select("conv_id", "turn", F.col("q.level").alias("level"), F.length("q.body").alias("size"), F.sha2("q.body", 256).alias("hash")).distinct()
    asked = cut(asked)
    origin = rows.select("conv_id", "turn", F.explode("own").alias("body")).select("conv_id", F.sha2("body", 256).alias("hash"), "turn").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    # a line that many messages of a conversation quote is asked for once: its askers are dealt out by how many they are
    many = asked.groupBy("conv_id", "hash").agg(F.count("*").alias("askers"))
    origin = cut(many.join(origin, ["conv_id", "hash"]))
    met = spread_join(asked, origin, ["conv_id", "hash"], "askers", asked.count()).filter("origin < turn")
    votes = met.groupBy("conv_id", "turn", "origin").agg(F.sum(F.when(F.col("level") == 1, F.col("size")).otherwise(0)).alias("weight"), F.count("*").alias("links"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("weight") > 0, F.struct("weight", "origin"))).alias("best"), F.sum("links").alias("n_linked"))
    parents = cut(parents.select("conv_id", "turn", F.col("best.origin").alias("parent_turn"), "n_linked"))

    # pointer doubling: each message's thread so far, and the ancestor it goes on from
    pad = lambda c: F.lpad(F.hex(F.col(c).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    threads = cut(parents.filter("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("up"), pad("turn").alias("tail"), F.lit(1).alias("depth")))
    for _ in range(ROUNDS):
        above = threads.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("tail").alias("tail2"), F.col("depth").alias("depth2"))
        joined = threads.join(above, ["conv_id", "up"], "left")
        if joined.filter("up2 is not null").isEmpty():
            break
        goes = F.col("up2").isNotNull()
        threads = cut(joined.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), F.when(goes, F.concat_ws("/", "tail2", "tail")).otherwise(F.col("tail")).alias("tail"), F.when(goes, F.col("depth") + F.col("depth2")).otherwise(F.col("depth")).alias("depth")))
    threads = threads.select("conv_id", "turn", F.concat_ws("/", pad("up"), "tail").alias("thread"), "depth")

    out = rows.select("conv_id", "turn", "role", "clean_text", F.size("passages").cast("long").alias("n_quoted"))
    out = out.join(parents, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("thread", pad("turn")).alias("thread"), "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "clean_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))
