"""N-gram Jaccard join: T-occurrence search with DivideSkip, one class id per document.

Two documents link when the Jaccard similarity of their word 5-shingle sets is
at least 0.8. The join runs in five steps; none gathers all documents, a hot
token, or a hot group of copies in one task:

1. *Classes.* Documents with the same set are one class, represented by its
   smallest id; the sets are compared by a 128-bit digest.
2. *T-occurrence bound.* A document that links to another shares at least
   T = ceil(0.8 n) of its n shingles with it. Of the smaller half of the hashes
   it therefore shares T - n/2 at least. Chunks of documents send their hashes
   to hash buckets (a hash met twice in a chunk is sent once, so a frequent
   shingle costs one entry a chunk; there are more buckets for more hashes), buckets
   report which are shared, and documents short of the bound are out of the join.
3. *Rarest-first prefixes.* For the rest, document frequencies are counted
   and each document keeps the n - T + 1 rarest shingles; linked documents share one
   of these, that is, meet in one inverted list.
4. *Search against leaders.* Each document is first compared with the smallest document, the leader,
   of each of its lists. The lists of one leader count as one; if all its documents are then
   connected it needs no more comparisons, however long it is.
5. *Search of the rest.* In a leader's other lists the documents outside
   the largest connected part are queries against all documents of the lists, in
   pairs of blocks of bounded size and of sizes that can link.

Steps 4 and 5 search blocks with DivideSkip: of the query's inverted lists the L
longest are put aside, the short ones are merged (a heap; a sort of the
concatenated runs where they are large), candidates found at least T - L times
are probed in the long lists by binary search, and the exact overlap decides.

Steps 4 and 5 look for links enough to connect what links, not for each. :func:`link_counts`
counts all of them: there every document of a leader's lists is a query against all
others, and two documents that meet in several leaders' lists are counted in the first.

Shingles are compared by 64-bit hashes.

Defined results: null and empty texts, and texts without words, have
``n_shingles`` 0 and their own id as ``component_id``. A text of fewer than five words
is one shingle of its whole sequence. Repeated rows of a ``doc_id`` give one row: the sets
of its rows each take part, and what links to one of them is connected with all; ``n_shingles`` is that of the largest.
Rows with a null id are left out. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import runtime
from .components import connected_components
from .kernels import mix, shingle_sets, tidy
from .runtime import cut, documents, drop, require, shuffle_partitions, sized, spread_join, with_row

#: Shingles of a document's ascending hashes that step 2 looks at.
HALF = 2
#: Documents of a unit: of a leader's lists, and of either side of a pair of blocks, on the average.
LEADER_BLOCK, BLOCK = 128, 256
#: Hashes in a bucket, and documents in a part of what buckets found, on the average at most: what a task of step 2 holds.
BUCKET_HASHES, PART_DOCS = 2_000_000, 2_000_000
#: Sizes of linked sets differ by a factor of 1.25 at most, so by one of these steps.
SIZE_STEP = 1.26
#: The tuning constant of DivideSkip's L = T / (MU * log2(longest list) + 1).
MU = 0.0085
HEAP_POSTINGS = 2048


def required(n):
    """Least overlap with any document that a set of n shingles can link to (also for arrays)."""
    return (4 * n + 4) // 5


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows, n, hi, lo = [], [], [], []
            for i, s in shingle_sets(batch.column(1), width):
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                rows.append(ids[i])
                n.append(len(s))
                hi.append(int.from_bytes(d[:8], "little", signed=True))
                lo.append(int.from_bytes(d[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["doc_id", "n", "hi", "lo"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, hi long, lo long")


def _bucketed(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """A row for each chunk of documents and bucket of hashes.

    ``tok`` has the bucket's distinct hashes met in the chunk (32 bits of them: more
    would only remove a rare false share), ``at`` the place in ``ids`` of the only
    document with it, or -1 when several have it; ``known`` counts, for each document,
    its hashes that others of the chunk have too.
    """

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            rows, sets = [], []
            for i, s in shingle_sets(batch.column(1), width):
                half = s[: -(-len(s) // HALF)]
                rows.append(np.full(len(half), i, dtype=np.int32))
                sets.append(half)
            if not sets:
                continue
            token, row = np.concatenate(sets), np.concatenate(rows)
            order = np.argsort(token, kind="stable")
            token, row = token[order], row[order]
            new = np.concatenate(([True], token[1:] != token[:-1]))[: len(token)]
            single = new & np.concatenate((new[1:], [True]))[: len(token)]
            bucket = (token % np.uint64(buckets)).astype(np.int64)
            short = ((token // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            bucket, short, row, new, single = bucket[order], short[order], row[order], new[order], single[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            out = [[], [], [], [], []]
            for b in range(buckets):
                part = slice(cuts[b], cuts[b + 1])
                if cuts[b] == cuts[b + 1]:
                    continue
                used, place = np.unique(row[part], return_inverse=True)
                at = np.where(single[part], place, -1).astype(np.int32)
                keep = new[part]
                known = np.bincount(place[~single[part]], minlength=len(used)).astype(np.int32)
                for column, value in zip(out, (b, ids[used].tobytes(), known.tobytes(), short[part][keep].tobytes(), at[keep].tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", "ids", "known", "tok", "at"])

    return docs.mapInArrow(tidy(run), "bucket int, ids binary, known binary, tok binary, at binary")


def _shared_counts(buckets: DataFrame, parts: int) -> DataFrame:
    """(doc_id, shared): hashes of a document that other documents have too.

    Buckets are closed one after another; what one finds goes out as one row for each
    part of the documents, and is added up there.
    """

    def close(chunks):
        tokens = np.concatenate([np.frombuffer(c[2], np.uint32) for c in chunks])
        order = np.argsort(tokens, kind="stable")
        ordered = tokens[order]
        same = np.zeros(len(ordered) + 1, dtype=bool)
        same[1:-1] = ordered[1:] == ordered[:-1]
        shared = np.zeros(len(tokens), dtype=bool)
        shared[order] = same[1:] | same[:-1]
        ids, counts, a = [], [], 0
        for c in chunks:
            at = np.frombuffer(c[3], np.int32)
            doc, count = np.frombuffer(c[0], np.int64), np.frombuffer(c[1], np.int32)
            hit = at[shared[a : a + len(at)] & (at >= 0)]
            a += len(at)
            count = (count + np.bincount(hit, minlength=len(doc))).astype(np.int32)
            ids.append(doc[count > 0])
            counts.append(count[count > 0])
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        part = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, ids[order[cuts[p] : cuts[p + 1]]].tobytes(), counts[order[cuts[p] : cuts[p + 1]]].tobytes()) for p in np.flatnonzero(np.diff(cuts))]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["part", "ids", "counts"])

    def run(batches):
        held, bucket = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != bucket and held:
                    yield close(held)
                    held = []
                bucket = row[0]
                held.append(row[1:])
        if held:
            yield close(held)

    def add(batches):
        ids, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            counts = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            ids, place = np.unique(np.concatenate([ids, *more]), return_inverse=True)
            sums = np.bincount(place, weights=np.concatenate([sums, *counts]), minlength=len(ids)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], ["doc_id", "shared"])

    found = buckets.sortWithinPartitions("bucket").mapInArrow(tidy(run), "part int, ids binary, counts binary")
    return found.repartition(parts, "part").mapInArrow(tidy(add), "doc_id long, shared long")


def _classes(profile: DataFrame) -> DataFrame:
    """(hi, lo, n, rep, size): the smallest document of each class, and how many rows it has."""
    return profile.filter("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))


def _repeat_links(profile: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (u, v) between the classes of ids that have several sets, if there are such ids."""
    key = F.struct("hi", "lo", "n")
    repeated = cut(profile.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a <> b").select("doc_id"))
    if repeated.isEmpty():
        return None
    owned = cut(profile.join(sized(repeated), "doc_id").join(classes, ["hi", "lo", "n"]).select("doc_id", "rep").distinct())
    return owned.join(owned.groupBy("doc_id").agg(F.min("rep").alias("low")), "doc_id").select(F.col("rep").alias("u"), F.col("low").alias("v")).filter("u <> v")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, n, shingles); ``key``, which is ``hi`` of the profile, tells apart the sets of a repeated id."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[i], int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=16).digest()[:8], "little", signed=True), len(s), s.tobytes()) for i, s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "key", "n", "shingles"])

    return docs.mapInArrow(tidy(run), "doc_id long, key long, n long, shingles binary")


def _tokens(sets: DataFrame) -> DataFrame:
    """(doc_id, key, n, token): a row for each shingle of each set."""

    def run(batches):
        for batch in batches:
            ids, keys, n = (batch.column(k).to_numpy() for k in range(3))
            flat = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            for a in range(0, len(flat), 256):
                part = slice(a, a + 256)
                columns = [np.repeat(x[part], n[part]) for x in (ids, keys, n)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate(flat[part]))], ["doc_id", "key", "n", "token"])

    return sets.mapInArrow(tidy(run), "doc_id long, key long, n long, token long")


def merge_short(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids in ascending lists, and in how many of the lists each is."""
    if sum(map(len, lists)) > HEAP_POSTINGS:
        return np.unique(np.concatenate(lists), return_counts=True)
    found, counts = [], []
    for x in heapq.merge(*(part.tolist() for part in lists)):
        if found and found[-1] == x:
            counts[-1] += 1
        else:
            found.append(x)
            counts.append(1)
    return np.array(found, dtype=np.int64), np.array(counts, dtype=np.int64)


class DivideSkip:
    """An inverted index of a block of sets, searched by overlap."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.tokens = tokens[order]
        self.docs = np.repeat(np.arange(len(sets)), self.sizes)[order]

    def search(self, query: np.ndarray) -> np.ndarray:
        """Places of the sets that link to ``query``: 9 * overlap >= 4 * (sum of both sizes)."""
        need = int(required(len(query)))
        low = np.searchsorted(self.tokens, query, side="left")
        high = np.searchsorted(self.tokens, query, side="right")
        present = np.flatnonzero(high > low)
        if not need or len(present) < need:
            return np.zeros(0, dtype=np.int64)
        present = present[np.argsort((high - low)[present], kind="stable")]
        longest = int((high - low)[present[-1]])
        aside = min(int(need / (MU * math.log2(longest + 1) + 1)), need - 1)
        short, long = present[: len(present) - aside], present[len(present) - aside :]
        found, counts = merge_short([self.docs[low[i] : high[i]] for i in short])
        kept = counts >= need - aside
        found, counts = found[kept], counts[kept]
        if len(found) > len(long):
            for i in long:
                posting = self.docs[low[i] : high[i]]
                at = np.minimum(np.searchsorted(posting, found), len(posting) - 1)
                counts = counts + (posting[at] == found)
        elif aside:
            probes = query[long]
            for k, d in enumerate(found):
                own = self.sets[d]
                at = np.minimum(np.searchsorted(own, probes), len(own) - 1)
                counts[k] += int((own[at] == probes).sum())
        return found[9 * counts >= 4 * (len(query) + self.sizes[found])]


def _search(units: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) found in units of queries and indexed documents, enough of them to connect what links.

    ``units(unit, doc_id, is_query)``; a unit holds some 2 * BLOCK documents.
    """

    def run(group: pa.Table) -> pa.Table:
        ids, query = group.column("doc_id").to_numpy(), group.column("is_query").to_numpy(zero_copy_only=False)
        arrays = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        indexed, asked = np.flatnonzero(~query), np.flatnonzero(query)
        u, v = [], []
        if len(indexed) and len(asked):
            index = DivideSkip([arrays[i] for i in indexed])
            root = {int(d): int(d) for d in ids}

            def top(x):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for q in asked:
                for hit in index.search(arrays[q]):
                    a, b = top(int(ids[q])), top(int(ids[indexed[hit]]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        u.append(int(ids[q]))
                        v.append(int(ids[indexed[hit]]))
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return units.join(sets.select("doc_id", "shingles"), "doc_id").groupBy("unit").applyInArrow(run, "u long, v long")


def _blocks(count, size: int = BLOCK) -> F.Column:
    return F.ceil(count / F.lit(size)).cast("int")


def _leader_units(pairs: DataFrame) -> DataFrame:
    """Each leader against the documents of its lists, so many documents a unit."""
    sizes = pairs.groupBy("leader").agg(_blocks(F.count("*"), LEADER_BLOCK).alias("blocks"))
    several = sized(sizes.filter("blocks > 1"))
    one = F.coalesce("blocks", F.lit(1))
    rows = pairs.join(several, "leader", "left").select("leader", F.pmod(F.xxhash64("doc_id"), one).cast("int").alias("block"), "doc_id", F.lit(False).alias("is_query"))
    asks = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("doc_id"), F.lit(True).alias("is_query"))
    return rows.unionAll(asks).select(F.struct("leader", "block").alias("unit"), "doc_id", "is_query")


def _open_lists(pairs: DataFrame, linked: DataFrame, total: int) -> DataFrame:
    """``(leader, doc_id, n, component)`` of the leaders whose documents aren't all connected."""
    members = pairs.join(linked.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    members = cut(members.select("leader", "doc_id", "n", "component"))
    states = members.groupBy("leader").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size"))
    out = cut(spread_join(members, cut(states.filter("a <> b").select("leader", "size")), ["leader"], "size", total).drop("size"))
    drop(members)
    return out


def _rest_units(members: DataFrame, total: int) -> DataFrame:
    """For each leader, all documents of its lists outside their largest connected part against all, by pairs of blocks.

    Documents are dealt by size too: a query asks those of its own step of sizes and of the two beside it.
    """
    parts = members.groupBy("leader", "component").agg(F.count("*").alias("size"))
    mains = cut(parts.groupBy("leader").agg(F.max_by("component", F.struct("size", F.negative("component"))).alias("main"), F.sum("size").alias("all")))
    rows = spread_join(members, mains, ["leader"], "all", total).withColumn("step", F.floor(F.log(F.col("n")) / math.log(SIZE_STEP)).cast("int"))
    rows = cut(rows.select("leader", "doc_id", "step", (F.col("component") != F.col("main")).alias("asks")))
    asked = rows.filter("asks").select("leader", "doc_id", F.explode(F.array(*[F.col("step") + d for d in (-1, 0, 1)])).alias("step"))
    plan = rows.groupBy("leader", "step").agg(F.count("*").alias("n_docs")).join(asked.groupBy("leader", "step").agg(F.count("*").alias("n_asks")), ["leader", "step"])
    plan = cut(plan.select("leader", "step", _blocks(F.col("n_docs")).alias("blocks"), _blocks(F.col("n_asks")).alias("asks"), "n_docs", "n_asks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = spread_join(rows.drop("asks"), plan, ["leader", "step"], "n_docs", total)
    index = index.select("leader", "step", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block"), every("asks").alias("ask"), "doc_id", F.lit(False).alias("is_query"))
    queries = spread_join(asked, plan, ["leader", "step"], "n_asks", 3 * total)
    queries = queries.select("leader", "step", every("blocks").alias("block"), F.pmod(F.xxhash64("doc_id", F.lit(1)), "asks").cast("int").alias("ask"), "doc_id", F.lit(True).alias("is_query"))
    return index.unionAll(queries).select(F.struct("leader", "step", "block", "ask").alias("unit"), "doc_id", "is_query")


@dataclass
class Lists:
    """What steps 1 to 3 give: the profile of all rows, the classes, and the sets and inverted lists of the documents in the join."""

    profile: DataFrame
    n_docs: int
    classes: DataFrame
    sets: DataFrame
    pairs: DataFrame
    total: int


def _lists(docs: DataFrame, id_col: str, text_col: str, width: int, *columns: str) -> Lists:
    """Steps 1 to 3; ``pairs`` has the leaders with these columns of the documents in their lists."""
    spark = docs.sparkSession
    docs = require(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    profile = cut(_profiles(docs, width))
    n_docs, n_hashes = profile.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = shuffle_partitions(spark)
    buckets, parts = max(least, n_hashes // HALF // BUCKET_HASHES), max(least, n_docs // PART_DOCS)
    classes = cut(_classes(profile))
    shared = _shared_counts(_bucketed(docs, width, buckets).repartition(buckets, "bucket"), parts)
    # one less than T - (n - looked at): rounding makes that bound fall by one between neighbouring sizes
    bound = F.ceil(F.col("n") * 4 / 5) - F.floor(F.col("n") / HALF) - 1
    live = classes.select(F.col("rep").alias("doc_id"), "n").join(shared, "doc_id").filter(F.col("shared") >= bound)
    live = sized(live.select("doc_id").distinct())

    sets = cut(_sets(docs.join(live, "doc_id", "left_semi"), width).filter("n > 0").dropDuplicates(["doc_id", "key"]))
    tokens = _tokens(sets)
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = cut(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    kept = spread_join(tokens, often, ["token"], "df", total)
    own = Window.partitionBy("doc_id", "key")
    kept = kept.withColumns({"shared": F.count("*").over(own), "place": F.row_number().over(own.orderBy("df", "token"))})
    need = F.ceil(F.col("n") * 4 / 5)
    # shingles of one document only come first in the order, so they use up places of the prefix
    prefix = kept.filter((F.col("shared") >= need) & (F.col("place") + F.col("n") - F.col("shared") <= F.col("n") - need + 1))
    prefix = cut(prefix.select("token", "doc_id", "key", "n"))
    drop(often)
    leaders = cut(prefix.groupBy("token").agg(F.min("doc_id").alias("leader"), F.count("*").alias("size")).filter("size > 1"))
    pairs = cut(spread_join(prefix, leaders, ["token"], "size", total).select("leader", *columns).distinct())
    drop(prefix)
    drop(leaders)
    return Lists(profile, n_docs, classes, sets, pairs, total)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each id; see the module's text."""
    at = _lists(docs, id_col, text_col, width, "doc_id", "n")
    profile, n_docs, classes, sets, pairs, total = at.profile, at.n_docs, at.classes, at.sets, at.pairs, at.total
    first = cut(_search(_leader_units(pairs.filter("leader != doc_id").select("leader", "doc_id").distinct()), sets))
    linked = cut(connected_components(first))
    members = _open_lists(pairs, F.broadcast(linked) if linked.count() <= runtime.BROADCAST_IDS else linked, total)
    more = [] if members.isEmpty() else [cut(_search(_rest_units(members, total), sets))]
    repeats = _repeat_links(profile, classes)
    more += [] if repeats is None else [repeats]
    found = linked
    if more:
        edges = linked.select(F.col("node").alias("u"), F.col("component").alias("v"))
        for m in more:
            edges = edges.unionAll(m)
        found = cut(connected_components(edges))
    for done in (pairs, members, sets):
        drop(done)

    moved = found.filter("node <> component").withColumnRenamed("node", "rep")
    classes = cut(classes.join(moved, "rep", "left").filter("size > 1 or component is not null").select("hi", "lo", "n", "size", F.coalesce("component", "rep").alias("component")))
    rows = spread_join(profile, classes, ["hi", "lo", "n"], "size", n_docs, "left")
    return rows.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("component", "doc_id")).alias("component_id"))


def _all_units(pairs: DataFrame, total: int) -> DataFrame:
    """Every document of a leader's lists as a query against all of them, by pairs of blocks of sizes that can link."""
    rows = pairs.withColumn("step", F.floor(F.log(F.col("n")) / math.log(SIZE_STEP)).cast("int"))
    plan = cut(rows.groupBy("leader", "step").agg(F.count("*").alias("n_docs"), _blocks(F.count("*")).alias("blocks")))
    beside = plan.groupBy("leader").agg(F.collect_list(F.struct("step", "blocks")).alias("steps"), F.sum("n_docs").alias("all")).filter("all > 1")
    plan = cut(plan.join(beside, "leader").select("leader", "step", "n_docs", "blocks", F.filter("steps", lambda s: F.abs(s["step"] - F.col("step")) <= 1).alias("others")))
    rows = spread_join(rows, plan, ["leader", "step"], "n_docs", total)
    rows = rows.select("leader", "doc_id", "key", F.col("step").alias("own_step"), F.pmod(F.xxhash64("doc_id", "key"), "blocks").cast("int").alias("own_block"), F.explode("others").alias("other"))
    rows = rows.select("leader", "doc_id", "key", "own_step", "own_block", F.col("other.step").alias("step"), F.explode(F.sequence(F.lit(0), F.col("other.blocks") - 1)).alias("block"))
    own, other = ("own_step", "own_block"), ("step", "block")
    unit = lambda indexed, asking: F.array(*map(F.col, indexed + asking))
    sides = F.create_map(F.lit(False), unit(own, other), F.lit(True), unit(other, own))
    return rows.select("leader", "doc_id", "key", F.explode(sides).alias("is_query", "place")).select(F.struct("leader", "place").alias("unit"), "leader", "doc_id", "key", "is_query")


def _count_links(units: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc_id, key, links): the rows of the classes that each class links to, each counted in the first leader that the two share."""

    def run(group: pa.Table) -> pa.Table:
        leader = group.column("leader")[0].as_py()
        query = group.column("is_query").to_numpy(zero_copy_only=False)
        ids, keys, sizes = (group.column(c).to_numpy() for c in ("doc_id", "key", "size"))
        arrays = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        before = [set(x) for x in group.column("before").to_pylist()]
        indexed, asked = np.flatnonzero(~query), np.flatnonzero(query)
        links = np.zeros(len(asked), dtype=np.int64)
        if len(indexed) and len(asked):
            index = DivideSkip([arrays[i] for i in indexed])
            with_leader: dict[int, list[int]] = {}
            for place, i in enumerate(indexed):
                for x in before[i]:
                    if x < leader:
                        with_leader.setdefault(x, []).append(place)
            for k, q in enumerate(asked):
                hits = index.search(arrays[q])
                counts = (ids[indexed[hits]] != ids[q]) | (keys[indexed[hits]] != keys[q])
                met = [with_leader[x] for x in before[q] if x in with_leader]
                if met:
                    counts &= ~np.isin(hits, np.concatenate(met))
                links[k] = sizes[indexed[hits]][counts].sum()
        some = links > 0
        return pa.table([pa.array(ids[asked][some]), pa.array(keys[asked][some]), pa.array(links[some])], ["doc_id", "key", "links"])

    found = units.join(marked, ["doc_id", "key"]).groupBy("unit").applyInArrow(run, "doc_id long, key long, links long")
    return found.groupBy("doc_id", "key").agg(F.sum("links").alias("links"))


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``(doc_id, n_links)``: for each id the number of other rows that its text links to.

    No pair leaves a task, but each has to be looked at: the time grows with the number of links. Empty sets have
    none. Of a repeated id, the row with the most counts, and its other rows are other rows to it.
    """
    at = _lists(docs, id_col, text_col, width, "doc_id", "key", "n")
    own = at.pairs.groupBy("doc_id", "key").agg(F.collect_list("leader").alias("before"))
    first = at.classes.select(F.col("rep").alias("doc_id"), F.col("hi").alias("key"), "n", "size")
    marked = cut(at.sets.join(first, ["doc_id", "key", "n"]).join(own, ["doc_id", "key"]).select("doc_id", "key", "size", "shingles", "before"))
    links = cut(_count_links(_all_units(at.pairs, at.total), marked))
    for done in (at.pairs, at.sets, marked):
        drop(done)
    counted = at.classes.join(links.select(F.col("doc_id").alias("rep"), F.col("key").alias("hi"), "links"), ["rep", "hi"], "left")
    counted = cut(counted.filter("size > 1 or links is not null").select("hi", "lo", "n", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    rows = spread_join(at.profile, counted, ["hi", "lo", "n"], "size", at.n_docs, "left")
    return rows.groupBy("doc_id").agg(F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near copies one row stays, whatever their ids: the one with the smallest (rows without an id last)."""
    rows = with_row(docs)
    classes = ngram_jaccard_join(rows.select("_row", "text"), id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    others = cut(classes.filter("component_id <> _row"))
    members = others.unionByName(others.select(F.col("component_id").alias("_row"), "component_id").distinct())
    members = cut(rows.select("_row", "doc_id").join(sized(members), "_row"))
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_row"))["_row"].alias("_row"))
    gone = members.select("_row").join(sized(first.select("_row")), "_row", "left_anti")
    return rows.join(sized(gone), "_row", "left_anti").select(*docs.columns)
