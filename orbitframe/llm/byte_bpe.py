"""Byte-level BPE encoding and decoding.

The result is that of the public library for the same rank file and pattern.

1. *Words.* Texts are cut as the pattern cuts them, by the kinds of neighbouring characters (letter, number, white space,
   other). Each distinct word is encoded once.
2. *Merges.* A word is an array of its bytes. A fold (higher-order aggregate) over it merges, again and again,
   the two neighbouring symbols whose joined bytes have the lowest rank, the leftmost in ties, until none have one. Ranks come from a
   literal map. A map is searched from its begin, so the literal is an array of ``BUCKETS`` small maps, which a crc32 of
   the bytes chooses from. Keys are bytes as characters 0 to 255.
   A step looks at all symbols of its word, so the few words of over ``LONG_WORD`` bytes are merged from a heap by :func:`merged` instead.
3. *Assembly.* The ids of the most frequent words (``DICTIONARY`` at most, some 16 bytes each) are broadcast. Documents with other words are
   put together in a second pass, to which their other words' ids come by a join; only their texts are shuffled.
4. *Decoding* concatenates the ids' bytes.

Words are told apart by 64-bit hashes in the third step.

Defined results: null and empty texts have no ids; decoding no ids gives no bytes. Repeated rows are encoded each, and so are rows with a
null id, which stays null. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import hash_words, tidy
from .runtime import BROADCAST_IDS, cut, documents, let, require, shuffle_partitions

BUCKETS = 1 << 14
DICTIONARY = 4_000_000
#: Steps in which a part of the words of one frequency is chosen by hash.
SHARES = 1 << 16
LONG_WORD = 96
WORDS_A_TASK = 40_000
PIECE_CHARS = 1 << 18
SEEN = 2_000_000
SLICE_ROWS = 512
#: Stands for "these two have no rank".
NONE = 1 << 30
LETTER, NUMBER, SPACE, OTHER = range(4)
#: Fixed: the endings that the pattern keeps apart after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
RESULT = "doc_id long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point."""
    import regex

    out = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            first, last = ord(every[run.start()]), ord(every[run.end() - 1])
            out[first : last + 1] = kind  # no run crosses the surrogates, which are of another kind
    return out


def word_runs(texts: list[str | None]):
    """By pieces of the batch: (first text, last text, characters, their code points, word starts, word ends, first word of each text)."""
    first, kind_of = 0, kinds()
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") < PIECE_CHARS):
            size += len(texts[last] or "")
            last += 1
        held = [t or "" for t in texts[first:last]]
        joined = "".join(held)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in held])))
        starts = np.flatnonzero(word_begins(points, kind_of[points], offsets))
        yield first, last, joined, points, starts, np.append(starts[1:], len(points)), np.searchsorted(starts, offsets)
        first = last


def word_begins(points: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which characters begin a word.

    A run of one kind is a word, and takes a single blank before it along. Of white space before other characters the last character is
    apart: the blank that goes along, or else a word of its own. An apostrophe that is a run without a blank makes a word with the ending after it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    run = edge[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(run)
    ends = np.append(starts[1:], n)
    begins = run.copy()
    # the last character of white space that something follows
    spaces = (kind[starts] == SPACE) & ~edge[ends]
    tail = ends[spaces] - 1
    begins[tail] = True
    along = tail[points[tail] == 0x20]
    begins[along + 1] = False
    # apostrophes
    mark = starts[(ends - starts == 1) & (points[starts] == 0x27) & ~edge[ends]]
    mark = mark[begins[mark]]
    mark = mark[kind[mark + 1] == LETTER]
    if len(mark):
        stop = ends[np.searchsorted(starts, mark + 1)]
        free = np.ones(len(mark), dtype=bool)
        for ending in ENDINGS:
            hit = free & (stop - mark - 1 >= len(ending))
            for k, c in enumerate(ending):
                hit &= points[np.minimum(mark + 1 + k, n - 1)] == ord(c)
            begins[mark[hit] + 1] = False
            after = mark[hit] + 1 + len(ending)
            begins[after[after < stop[hit]]] = True
            free &= ~hit
    return begins


def _slices(batches):
    """Smaller batches, so that Python holds few texts at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(first, SLICE_ROWS)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct words of all texts, and how many tasks met each (more for one that a task forgot)."""

    def run(batches):
        seen = np.zeros(0, np.uint64)
        for batch in _slices(batches):
            for _, _, joined, points, starts, ends, _ in word_runs(batch.column(0).to_pylist()):
                hashes, at = np.unique(hash_words(points, starts, ends), return_index=True)
                if len(seen):
                    new = seen[np.minimum(np.searchsorted(seen, hashes), len(seen) - 1)] != hashes
                    hashes, at = hashes[new], at[new]
                seen = np.sort(np.concatenate((seen if len(seen) < SEEN else seen[:0], hashes)), kind="stable")
                words = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])

    return docs.select("text").mapInArrow(tidy(run), "word string").groupBy("word").agg(F.count("*").alias("n"))


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as a constant: by crc32 of the bytes modulo BUCKETS, a map from bytes (as characters 0 to 255) to their rank."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for key, rank in ranks.items():
        buckets[zlib.crc32(key) % BUCKETS][key.decode("latin-1")] = rank
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def rank_of(table: Column, key: Column) -> Column:
    bucket = (F.crc32(F.encode(key, "ISO-8859-1")) % BUCKETS).cast("int")
    return F.coalesce(F.get(table, bucket)[key], F.lit(NONE))


def merged_ids(word: Column, table: Column) -> Column:
    """The ids of ``word``, its bytes as characters 0 to 255.

    The state holds the symbols as ``struct<start, pair>``: where each starts, and the rank that it has with the next one.
    """
    n = F.length(word)
    cut_of = lambda a, b: word.substr(a + 1, b - a)

    def first_state() -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("start"), F.when(i < n - 1, rank_of(table, cut_of(i, i + 2))).otherwise(F.lit(NONE)).alias("pair")))

    def step(state: Column) -> Column:
        lowest = F.array_min(F.transform(state, lambda s, i: F.struct(s["pair"].alias("pair"), i.alias("at"))))

        def merge(best: Column) -> Column:
            at = best["at"]
            start = lambda k: F.coalesce(F.get(state, k)["start"], n)
            again = lambda k, a, b, c: F.when(b < n, rank_of(table, cut_of(a, c))).otherwise(F.lit(NONE)) if k else None
            # the symbol before the merged one, and the merged one, have new neighbours
            kept = F.filter(F.transform(state, lambda s, i: F.struct(
                s["start"].alias("start"),
                F.when(i == at - 1, rank_of(table, cut_of(s["start"], start(at + 2)))).when(i == at, again(True, s["start"], start(at + 2), start(at + 3))).otherwise(s["pair"]).alias("pair"),
            )), lambda s, i: i != at + 1)
            return F.when(best["pair"] == NONE, state).otherwise(kept)

        return let(lowest, merge)

    def run(first: Column) -> Column:
        # a word of n bytes has n - 1 merges at most; a step that finds none leaves the state as it is
        last = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), first, lambda acc, _: F.when(F.array_min(F.transform(acc, lambda s: s["pair"])) == NONE, acc).otherwise(step(acc)))
        return let(last, lambda s: F.transform(s, lambda x, i: rank_of(table, cut_of(x["start"], F.coalesce(F.get(s, i + 1)["start"], n)))))

    whole = rank_of(table, word)
    return let(whole, lambda w: F.when(w != NONE, F.array(w)).otherwise(let(first_state(), run)))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """What the fold gives, by merges from a heap: for long words."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(start: int) -> None:
        if end[start] < n:
            rank = ranks.get(word[start : end[end[start]]])
            if rank is not None:
                heapq.heappush(heap, (rank, start, end[end[start]]))

    for i in range(n):
        offer(i)
    while heap:
        _, start, stop = heapq.heappop(heap)
        if not alive[start] or end[start] >= n or end[end[start]] != stop:
            continue
        alive[end[start]] = False
        end[start] = stop
        if stop < n:
            before[stop] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def encode_words(words: DataFrame, ranks: dict[bytes, int], parts: int) -> DataFrame:
    """``words(word, n)`` with ``ids``."""
    spark = words.sparkSession
    size = F.octet_length("word")
    short = words.filter(size <= LONG_WORD).repartition(parts, "word").withColumn("bytes", F.decode(F.col("word").cast("binary"), "ISO-8859-1"))
    folded = short.select("word", "n", let(rank_literal(ranks), lambda table: merged_ids(F.col("bytes"), table)).alias("ids"))
    sent = spark.sparkContext.broadcast(ranks)

    def run(batches):
        for batch in _slices(batches):
            ids = [merged(w.encode(), sent.value) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return folded.unionAll(words.filter(size > LONG_WORD).mapInArrow(tidy(run), "word string, n long, ids array<int>"))


def most_frequent(encoded: DataFrame, bound: int) -> DataFrame:
    """About the ``bound`` words with the highest ``n``, and no more: by a threshold from the counts of each ``n``, so no rows are sorted.

    Of the words at the threshold those with the least hashes are in.
    """
    spot = F.pmod(F.xxhash64("word"), F.lit(SHARES))
    held, least = 0, None
    for n, words in sorted(((r.n, r.words) for r in encoded.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True):  # a row a number of tasks
        if held + words > bound:
            # a hundredth less, as hashes don't fall quite evenly
            share = int(max(0.0, 0.99 * (bound - held) / words - 0.001) * SHARES)
            edge = (F.col("n") == n) & (spot < share)
            return encoded.filter(edge if least is None else (F.col("n") >= least) | edge)
        held, least = held + words, n
    return encoded


def _packed(encoded: DataFrame) -> tuple[np.ndarray, ...]:
    """Ascending word hashes, begins and sizes of their ids, and the ids, of DICTIONARY words at most."""

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            edges = np.concatenate(([0], np.cumsum([len(w) for w in words])))
            lists = batch.column(1)
            parts = (hash_words(points, edges[:-1], edges[1:]), np.diff(lists.offsets.to_numpy()).astype(np.uint32), lists.flatten().to_numpy().astype(np.uint16))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["hash", "sizes", "flat"])

    rows = encoded.select("word", "ids").mapInArrow(tidy(run), "hash binary, sizes binary, flat binary").collect()
    hashes, sizes, flat = (np.frombuffer(b"".join([r[k] for r in rows]), kind) for k, kind in enumerate((np.uint64, np.uint32, np.uint16)))
    del rows
    order = np.argsort(hashes, kind="stable")
    return hashes[order], (np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.uint32)[order], sizes[order], flat


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begins[k] .. begins[k] + sizes[k] of all k, one after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def _lookup(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the dictionary, whether it is there) of each hash."""
    if not len(known):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    distinct, back = np.unique(hashes, return_inverse=True)
    at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
    return at[back], (known[at] == distinct)[back]


def _assembly(docs: DataFrame, ranks: dict[bytes, int], dictionary: int):
    """Parts of the documents, each with the function from its batches to (doc ids, edges of their ids, ids) by piece."""
    spark = docs.sparkSession
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids of over 16 bits")
    docs = require(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = cut(vocabulary(docs))
    encoded = cut(encode_words(words, ranks, max(shuffle_partitions(spark), words.count() // WORDS_A_TASK)))
    whole = encoded.count() <= dictionary
    sent = spark.sparkContext.broadcast(_packed(encoded if whole else most_frequent(encoded, dictionary)))

    def rest(batches):
        """The words of each text that the dictionary lacks."""
        for batch in _slices(batches):
            keys = batch.column(0).to_pylist()
            for first, last, joined, points, starts, ends, bounds in word_runs(batch.column(1).to_pylist()):
                lost = ~_lookup(sent.value[0], hash_words(points, starts, ends))[1]
                row = np.repeat(np.arange(last - first), np.diff(bounds))[lost]
                found = {(keys[first + r], joined[starts[i] : ends[i]]) for r, i in zip(row.tolist(), np.flatnonzero(lost).tolist(), strict=True)}
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], ["key", "word"])

    def assemble(batches, rest: bool = False):
        """Of each piece of a batch the rows all of whose words the dictionary has, or with ``rest`` the others."""
        hashes_of, begins_of, sizes_of, flat_of = sent.value
        for batch in _slices(batches):
            extra = batch.column(2).to_pylist() if rest else [None] * batch.num_rows
            for first, last, joined, points, starts, ends, bounds in word_runs(batch.column(1).to_pylist()):
                at, there = _lookup(hashes_of, hash_words(points, starts, ends))
                row = np.repeat(np.arange(last - first), np.diff(bounds))
                kept = np.zeros(last - first, dtype=bool)
                kept[row[~there]] = True
                kept = kept if rest else ~kept
                mine = kept[row]
                at, there, row = at[mine], there[mine], row[mine]
                begins, sizes, flat = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), flat_of
                begins[there], sizes[there] = begins_of[at[there]], sizes_of[at[there]]
                if rest:
                    own = {x["word"]: x["ids"] for e in extra[first:last] for x in e or ()}
                    missing = [own[joined[a:b]] for a, b in zip(starts[mine][~there].tolist(), ends[mine][~there].tolist(), strict=True)]
                    counts = np.array([len(m) for m in missing], dtype=np.int64)
                    begins[~there], sizes[~there] = len(flat) + np.cumsum(counts) - counts, counts
                    flat = np.concatenate((flat, np.array([i for m in missing for i in m], dtype=np.uint16)))
                tokens = np.bincount(row, weights=sizes, minlength=last - first).astype(np.int64)[kept]
                yield batch.column(0).slice(first, last - first).filter(pa.array(kept)), np.concatenate(([0], np.cumsum(tokens))), flat[_ranges(begins, sizes)]

    parts = [(docs, assemble)]
    if not whole:
        # rows of one key get the words of all of them, so equal keys do no harm
        key = F.coalesce("doc_id", F.xxhash64("text")).alias("key")
        lost = docs.select(key, "text").mapInArrow(tidy(rest), "key long, word string").distinct().join(encoded.drop("n"), "word")
        lost = cut(lost.groupBy("key").agg(F.collect_list(F.struct("word", "ids")).alias("extra")))
        keys = lost.select("key")
        keyed = docs.select("doc_id", "text", key)
        if keys.count() <= BROADCAST_IDS:  # few documents have such words: the texts of the others stay where they are
            keyed = keyed.join(F.broadcast(keys), "key", "left_semi")
        parts.append((keyed.join(lost, "key").select("doc_id", "text", "extra"), lambda batches: assemble(batches, rest=True)))
    return parts


def _over(parts, run, schema: str) -> DataFrame:
    """``run`` over what each part's assembly yields."""
    outputs = [df.mapInArrow(tidy(lambda batches, put=put: run(put(batches))), schema) for df, put in parts]
    return outputs[0] if len(outputs) == 1 else outputs[0].unionAll(outputs[1])


def encode(docs: DataFrame, rank_path: str | None = None, dictionary: int = DICTIONARY) -> DataFrame:
    """``(doc_id, ids)`` of each row of ``docs(doc_id, text)``."""
    parts = _assembly(docs, load_ranks(rank_path or default_ranks()), dictionary)

    def run(pieces):
        for keys, edges, ids in pieces:
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return _over(parts, run, RESULT)


def _pieces(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and sizes of the ids' bytes, and all bytes."""
    by_id = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        by_id[rank] = piece
    sizes = np.array([len(b) for b in by_id], dtype=np.int64)
    return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(by_id), dtype=np.uint8)


def decoded(ids: np.ndarray, pieces) -> bytes:
    """The bytes of all ids, one after another."""
    begins, sizes, data = pieces
    return data[_ranges(begins[ids], sizes[ids])].tobytes()


def decode(encoded: DataFrame, rank_path: str | None = None) -> DataFrame:
    """``encoded(doc_id, ids)`` to ``(doc_id, decoded)``, as bytes; null ids give none."""
    sent = encoded.sparkSession.sparkContext.broadcast(_pieces(load_ranks(rank_path or default_ranks())))

    def run(batches):
        for batch in _slices(batches):
            texts = [decoded(x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32), sent.value) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, decoded binary")


def round_trip(docs: DataFrame, rank_path: str | None = None, dictionary: int = DICTIONARY) -> DataFrame:
    """Digests of each row's ids (little-endian, 32 bits) and of what they decode to, in one pass of one worker a task."""
    ranks = load_ranks(rank_path or default_ranks())
    sent = docs.sparkSession.sparkContext.broadcast(_pieces(ranks))

    def run(pieces):
        for keys, edges, ids in pieces:
            rows = [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            digests = [pa.array([hashlib.sha256(b).hexdigest() for b in part], pa.string()) for part in ((r.astype("<u4").tobytes() for r in rows), (decoded(r, sent.value) for r in rows))]
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(edges).astype(np.int64)), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _over(_assembly(docs, ranks, dictionary), run, DIGESTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
