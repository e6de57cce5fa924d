"""Merkle dataset manifest by bitmap ranks.

DataFrame expressions only.

1. *Leaves.* Each row's digest, taken where the text is read; only digests, ids and sources go on.
2. *Bitmaps.* The ids of a source become 64-bit words (``bit_or``, combined before the shuffle), and the words that
   hold any id are gathered by container of ``CONTAINER`` ids: a compressed bitmap. Beside each word stands
   the number of rows before it in the container, and beside each container that before it in the source: the popcount directory.
3. *Ranks.* A leaf's coordinate is directory + directory + popcount of the word's lower bits. No leaf is sorted. Only
   rows that share an id with others of the source are numbered among themselves, by digest, in groups that a digest's first bits name.
4. *Levels.* Nodes meet in slot arrays of ``SPAN`` consecutive ones, keyed by (source, place div SPAN), and each array is
   reduced by as many levels as it holds. So there is a shuffle for every six levels, and no array is longer than SPAN. The
   arrays also give each node its siblings; those of higher levels come down by a join on the key. Subroots, numbered in
   the order of their sources, go through the same steps.

Defined results: a null value of any of the five columns is hashed as ``-``. Rows with a null id come first in their source.
Rows that share an id are in the order of their leaves' hex digests, and wholly equal rows take consecutive places, so each has a proof of its own. A null
source is a group of its own, the first. An empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import cut, documents, require, shuffle_partitions, spread_join

FANOUT = 3
LEVELS = 6
#: Nodes in a slot array.
SPAN = FANOUT**LEVELS
#: Ids in a container of the bitmap, as a power of two, and ids in a word.
CONTAINER_BITS = 15
WORD_BITS = 6


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The hex digest of a row's five values, each with its length in bytes."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(F.concat(*[part(c.cast("string")) for c in (doc_id, source, lang, n_chars, text)]))


def leaves(docs: DataFrame) -> DataFrame:
    """``(doc_id, source_key, leaf, tampered)``: digests as bytes; ``tampered`` is null where the row isn't tampered with."""
    rows = require(docs, "doc_id", "source", "lang", "n_chars", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    # an empty key is the null source, so it comes first
    return rows.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source_key"), F.unhex(leaf(*values, text)).alias("leaf"),
        F.when(hit, F.unhex(leaf(*values, F.replace(text, F.lit("\n"), F.lit(""))))).alias("tampered"),
    )


def _lower(bits: Column, bit: Column) -> Column:
    """How many of ``bits`` are below place ``bit``."""
    return F.bit_count(bits.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))))


def rank_index(rows: DataFrame) -> DataFrame:
    """``rows(source_key, doc_id)`` to ``(source_key, container, n_rows, before, words)``: a source's bitmap, a container a row.

    ``words`` holds, by word number, its bits, the number of rows before it in the container, and the ids that more than one row
    has, with how many more; ``before`` is the number of the source's rows in earlier containers, those without an id included.
    """
    named = rows.filter("doc_id is not null")
    word, bit = F.shiftright("doc_id", WORD_BITS), F.col("doc_id").bitwiseAND(63).cast("int")
    words = cut(named.groupBy("source_key", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"), F.count("*").alias("n")))
    # words whose rows outnumber their bits hold repeated ids
    crowded = words.filter(F.col("n") > F.bit_count("bits")).select("source_key", "word", "n")
    if crowded.isEmpty():
        words = words.withColumn("more", F.lit(None).cast("array<struct<bit:int,more:bigint>>"))
    else:
        crowded = cut(crowded)
        among = spread_join(named.select("source_key", "doc_id", word.alias("word")), crowded, ["source_key", "word"], "n", crowded.agg(F.sum("n")).first()[0])
        repeated = among.groupBy("source_key", "word", bit.alias("bit")).agg((F.count("*") - 1).alias("more")).filter("more > 0")
        words = words.join(repeated.groupBy("source_key", "word").agg(F.collect_list(F.struct("bit", "more")).alias("more")), ["source_key", "word"], "left")
    container = F.shiftright("word", CONTAINER_BITS - WORD_BITS)
    inside = Window.partitionBy("source_key", "container").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("container", container).withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    held = placed.groupBy("source_key", "container").agg(F.sum("n").alias("n_rows"), F.collect_list(F.struct("word", "before", "bits", "more")).alias("words"))
    nameless = rows.filter("doc_id is null").groupBy("source_key").agg(F.count("*").alias("nameless"))
    held = held.join(nameless, "source_key", "left")
    # a row a container here, not a row a document
    earlier = Window.partitionBy("source_key").orderBy("container").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("before", F.coalesce("nameless", F.lit(0)) + F.coalesce(F.sum("n_rows").over(earlier), F.lit(0))).drop("nameless")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows(source_key, doc_id, leaf, tampered)``, a cut table, with ``place``: the row's number in its source, from 0."""
    index = cut(rank_index(rows))
    total = rows.count()
    named = rows.filter("doc_id is not null").withColumn("container", F.shiftright("doc_id", CONTAINER_BITS))
    met = spread_join(named, index, ["source_key", "container"], "n_rows", total)
    word, bit = F.shiftright("doc_id", WORD_BITS), F.col("doc_id").bitwiseAND(63).cast("int")
    at = F.array_position(F.transform("words", lambda w: w["word"]), word).cast("int") - 1
    met = met.select("source_key", "doc_id", "leaf", "tampered", "before", F.get("words", at).alias("word"))
    more = lambda keep: F.aggregate(F.filter(F.coalesce("word.more", F.array().cast("array<struct<bit:int,more:bigint>>")), keep), F.lit(0).cast("long"), lambda acc, x: acc + x["more"])
    first = F.col("before") + F.col("word.before") + _lower(F.col("word.bits"), bit) + more(lambda x: x["bit"] < bit)
    met = met.select("source_key", "doc_id", "leaf", "tampered", first.alias("place"), (more(lambda x: x["bit"] == bit) > 0).alias("shared"))
    nameless = rows.filter("doc_id is null").select("source_key", "doc_id", "leaf", "tampered", F.lit(0).cast("long").alias("place"), F.lit(True).alias("shared"))
    met = cut(met.unionByName(nameless))
    shared = met.filter("shared").drop("shared")
    if shared.isEmpty():
        return met.drop("shared")
    # rows of one id: equal ones are one row with a count, and only those of one prefix of the digest are sorted together
    same = shared.groupBy("source_key", "doc_id", "place", "leaf", "tampered").agg(F.count("*").alias("copies")).withColumn("prefix", F.substring("leaf", 1, 2))
    same = cut(same)
    keys = ["source_key", "place"]
    among = Window.partitionBy(*keys, "prefix").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)  # a row a prefix: 65 536 at most
    offsets = same.groupBy(*keys, "prefix").agg(F.sum("copies").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    numbered = same.withColumn("inside", F.coalesce(F.sum("copies").over(among), F.lit(0))).join(offsets, [*keys, "prefix"])
    start = F.col("place") + F.col("ahead") + F.col("inside")
    spread = numbered.select("source_key", "doc_id", "leaf", "tampered", F.explode(F.sequence(start, start + F.col("copies") - 1)).alias("place"))
    return met.filter("not shared").drop("shared").unionByName(spread)


def depth(n: Column) -> Column:
    """How many levels join ``n`` nodes into one."""
    powers = F.array(*[F.lit(FANOUT**k).cast("long") for k in range(39)])
    return F.size(F.filter(powers, lambda p: p < n))


def _hash_runs(nodes: Column) -> Column:
    """The next level of an array of nodes."""
    child = lambda i, k: F.coalesce(F.get(nodes, i * FANOUT + k), F.lit(""))
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: digest(F.concat(*[child(i, k) for k in range(FANOUT)])))


def _with_levels(arrays: DataFrame, first: int) -> DataFrame:
    """``arrays(key, block, n, slots)`` with ``l0`` .. ``l6``, the nodes by level from ``first`` on; a finished group's stay as they are."""
    out = arrays.withColumn("l0", F.transform("slots", lambda s: s["node"]))
    for k in range(LEVELS):
        out = out.withColumn(f"l{k + 1}", F.when(depth(F.col("n")) > first + k, _hash_runs(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    return out


def _siblings(slot: Column, first: int) -> Column:
    """The siblings of a slot's node and of those above it in the array, a level each: what stands before it, and what after."""

    def level(k: int) -> Column:
        x = F.floor(slot / FANOUT**k).cast("int")
        of = lambda i, there: F.when(there, F.coalesce(F.get(F.col(f"l{k}"), i), F.lit(""))).otherwise("")
        mine = x % FANOUT
        before = F.concat(*[of(x - mine + i, F.lit(i) < mine) for i in range(FANOUT - 1)])
        after = F.concat(*[of(x - mine + i, F.lit(i) > mine) for i in range(1, FANOUT)])
        return F.when(depth(F.col("n")) > first + k, F.struct(before.alias("before"), after.alias("after")))

    return F.filter(F.array(*[level(k) for k in range(LEVELS)]), lambda p: p.isNotNull())


def proofs(nodes: DataFrame, *payload: str) -> DataFrame:
    """``nodes(key, n, place, node, *payload)``, ``n`` nodes a key, to ``(key, *payload, node, top, path)``.

    ``top`` is what remains of the key's nodes; ``path`` the siblings from the node up to it.
    """
    levels: list[DataFrame] = []
    now, first = nodes.select("key", "n", "place", "node", *payload), 0
    while True:
        slot = F.struct((F.col("place") % SPAN).cast("int").alias("slot"), "node", *(payload if first == 0 else ()))
        arrays = now.groupBy("key", "n", F.floor(F.col("place") / SPAN).alias("block")).agg(F.array_sort(F.collect_list(slot), lambda a, b: a["slot"] - b["slot"]).alias("slots"))
        # written, so that no level hashes anew
        table = cut(_with_levels(arrays, first))
        levels.append(table)
        # a group of one array is done; its upper levels are left out below
        now = table.filter(F.col("n") > F.lit(SPAN) ** (len(levels))).select("key", "n", F.col("block").alias("place"), F.get(f"l{LEVELS}", 0).alias("node"))
        first += LEVELS
        if now.isEmpty():
            break
    above: DataFrame | None = None
    for r in range(len(levels) - 1, -1, -1):
        table = levels[r]
        if above is None:
            table = table.withColumns({"top": F.get(f"l{LEVELS}", 0), "upper": F.array().cast("array<struct<before:string,after:string>>")})
        else:
            table = table.join(above, ["key", "block"], "left")
            table = table.withColumns({"top": F.coalesce("top", F.get(f"l{LEVELS}", 0)), "upper": F.coalesce("upper", F.array().cast("array<struct<before:string,after:string>>"))})
        keep = [f"l{k}" for k in range(LEVELS)]
        out = table.select("key", "n", "block", "top", "upper", *keep, F.explode("slots").alias("s"))
        path = F.concat(_siblings(F.col("s.slot"), r * LEVELS), "upper").alias("path")
        if r:
            above = out.select("key", (F.col("block") * SPAN + F.col("s.slot")).alias("block"), "top", path.alias("upper"))
        else:
            return out.select("key", *[F.col(f"s.{p}").alias(p) for p in payload], F.col("s.node").alias("node"), "top", path)
    raise AssertionError


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` gives with the siblings of ``path``."""
    return F.aggregate(path, start, lambda acc, p: digest(F.concat(p["before"], acc, p["after"])))


def numbered_sources(sources: DataFrame) -> DataFrame:
    """``sources(source_key, ...)`` with ``place``, the number in the order of the keys: sorted by ranges, numbered by part."""
    parts = shuffle_partitions(sources.sparkSession)
    ordered = cut(sources.repartitionByRange(parts, "source_key").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    offsets = ordered.groupBy("part").agg(F.count("*").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("source_key")) - 1
    return ordered.withColumn("inside", inside).join(F.broadcast(offsets.select("part", "before")), "part").withColumn("place", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def manifest(docs: DataFrame) -> DataFrame:
    """``(doc_id, source_key, leaf, tampered, subroot, root, path)`` of each row; ``path`` leads from the leaf to the root."""
    rows = cut(leaves(docs))
    sources = cut(rows.groupBy("source_key").agg(F.count("*").alias("n")))
    placed = spread_join(ranked(rows), sources, ["source_key"], "n", rows.count())
    placed = placed.select(F.col("source_key").alias("key"), "n", "place", F.lower(F.hex("leaf")).alias("node"), "doc_id", "tampered")
    own = cut(proofs(placed, "doc_id", "tampered"))
    tops = own.groupBy("key").agg(F.first("top").alias("node")).withColumnRenamed("key", "source_key")
    tops = numbered_sources(tops).crossJoin(F.broadcast(sources.agg(F.count("*").alias("n")))).select(F.lit("").alias("key"), "n", "place", "node", "source_key")
    upper = proofs(tops, "source_key").select("source_key", F.col("top").alias("root"), F.col("path").alias("upper"))
    upper = cut(upper.join(sources, "source_key"))
    own = own.withColumnRenamed("key", "source_key")
    met = spread_join(own, upper, ["source_key"], "n", rows.count())
    return met.select("doc_id", "source_key", F.col("node").alias("leaf"), "tampered", F.col("top").alias("subroot"), "root", F.concat("path", "upper").alias("path"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's leaf, roots and proof, and whether the root still follows from the (tampered) row."""
    rows = manifest(documents(spark, sf_dir))
    again = folded(F.coalesce(F.lower(F.hex("tampered")), "leaf"), F.col("path"))
    proof = digest(F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), ""))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
