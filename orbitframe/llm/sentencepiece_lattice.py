"""SentencePiece encoding and decoding on a relational lattice.

The result is that of the public library for the same model file.

1. *Units.* Texts are cut wherever no piece holds the two neighbouring characters side by side
   (each word begins with its space, so words are cut off too). No piece crosses
   such a cut, so units can be encoded apart, each distinct one only once.
2. *Lattice.* The distinct units explode into substrings as long as the longest piece, an
   equality join to the piece table finds the edges, and edges are grouped by unit. A fold (higher-order
   aggregate) over them gives the ids. For a unigram model it is Viterbi's: over the end
   positions, the path with the largest sum of scores (ties: the longer last piece). For a
   BPE model sums of scores don't give the model's own segmentation, so there the fold is over
   merges: of the edges that join two neighbouring symbols the best-scored one, leftmost
   in ties, until none does. Where each piece is merged from better ones, one pass over the edges from the best on
   makes the same merges (:func:`ranked_path`). Viterbi's path over the same edges and its score come beside it on request
   (``paths``; the query gives both). Characters without a piece are spelt in byte pieces. A fold looks at all edges of a unit in each step,
   so the few units of over ``LONG_UNIT`` characters (unbroken runs) are encoded by :func:`encode_long` instead, in
   a time that grows with their length only.
3. *Assembly.* The encodings of the most frequent units (``DICTIONARY`` at most, chosen by a threshold on
   their counts) are broadcast. If there are more units, the rest of a document's units are joined to it by the shuffle.

Units are told apart by 64-bit hashes in the last step.

Defined results: null and empty texts have no ids; decoding no ids gives an empty text.
Repeated rows are encoded each, and so are rows with a null id, which stays null. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import most_frequent
from .kernels import hash_words, release, tidy
from .runtime import cut, documents, let, require, shuffle_partitions

SPACE = "▁"
DICTIONARY = 3_000_000
PIECE_CHARS = 1 << 18
LONG_UNIT = 200
UNITS_A_TASK = 40_000
SEEN = 2_000_000
SLICE_ROWS = 512
UNKNOWN_PENALTY = 10.0
RESULT = "doc_id long, ids array<int>"
DECODED = "doc_id long, n_ids long, ids_crc32 long, decoded string"
#: What ``paths`` adds to either.
PATH = ", path array<int>, path_score double"
PATH_DIGEST = ", n_path_ids long, path_crc32 long, path_score double"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    """The piece table of a model file."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]
    merges: bool

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        normal = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in size]
        proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        merges = proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        return cls([model.id_to_piece(i) for i in size], [model.get_score(i) for i in size], normal, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], merges)

    @property
    def longest(self) -> int:
        return max(len(p) for p, n in zip(self.pieces, self.normal, strict=True) if n)

    @property
    def unknown_score(self) -> float:
        return min(s for s, n in zip(self.scores, self.normal, strict=True) if n) - UNKNOWN_PENALTY

    def late(self) -> set[str]:
        """The pieces that merging gives from a part no better than themselves; their edges can begin to fit after worse ones were merged."""
        score = {p: s for p, s, n in zip(self.pieces, self.scores, self.normal, strict=True) if n}
        out = set()
        for piece in score:
            parts, last = list(piece), [math.inf] * len(piece)
            while len(parts) > 1:
                best = max(((score[a + b], -i) for i, (a, b) in enumerate(pairwise(parts)) if a + b in score), default=None)
                if best is None:
                    break
                i = -best[1]
                if len(parts) == 2 and best[0] >= min(last):
                    out.add(piece)
                parts[i : i + 2], last[i : i + 2] = [parts[i] + parts[i + 1]], [best[0]]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        late = self.late() if self.merges else ()
        rows = [(p, i, s, p in late) for i, (p, s, n) in enumerate(zip(self.pieces, self.scores, self.normal, strict=True)) if n]
        return spark.createDataFrame(rows, "piece string, id int, score double, late boolean")

    def joints(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each character of longer pieces (0: none), and which pairs stand side by side in a piece."""
        pairs = sorted({p[i : i + 2] for p, n in zip(self.pieces, self.normal, strict=True) if n for i in range(len(p) - 1)})
        place = {c: k + 1 for k, c in enumerate(sorted({c for pair in pairs for c in pair}))}
        number = np.zeros(0x110000, dtype=np.int16)
        for c, k in place.items():
            number[ord(c)] = k
        beside = np.zeros((len(place) + 1, len(place) + 1), dtype=bool)
        for a, b in pairs:
            beside[place[a], place[b]] = True
        return number, beside


def unit_runs(texts: list[str | None], joints: tuple[np.ndarray, np.ndarray]):
    """By pieces of the batch: (first text, last text, characters, their code points, unit starts, unit ends, first unit of each text)."""
    number, beside = joints
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") < PIECE_CHARS):
            size += len(texts[last] or "")
            last += 1
        spaced = [" " + t if t else "" for t in texts[first:last]]
        joined = "".join(spaced).replace(" ", SPACE)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in spaced])))
        kind = number[points]
        begins = np.ones(len(points), dtype=bool)
        begins[1:] = ~beside[kind[:-1], kind[1:]]
        begins[offsets[:-1][offsets[:-1] < len(points)]] = True
        starts = np.flatnonzero(begins)
        yield first, last, joined, points, starts, np.append(starts[1:], len(points)), np.searchsorted(starts, offsets)
        first = last


def _slices(batches):
    """Smaller batches, so that Python holds few texts at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(first, SLICE_ROWS)


def vocabulary(docs: DataFrame, joints) -> DataFrame:
    """(unit, n): the distinct units of all texts, and how many tasks met each (more for one that a task forgot)."""
    sent = docs.sparkSession.sparkContext.broadcast(joints)

    def run(batches):
        seen = np.zeros(0, np.uint64)
        for batch in _slices(batches):
            for _, _, joined, points, starts, ends, _ in unit_runs(batch.column(0).to_pylist(), sent.value):
                hashes, at = np.unique(hash_words(points, starts, ends), return_index=True)
                if len(seen):
                    new = seen[np.minimum(np.searchsorted(seen, hashes), len(seen) - 1)] != hashes
                    hashes, at = hashes[new], at[new]
                seen = np.sort(np.concatenate((seen if len(seen) < SEEN else seen[:0], hashes)), kind="stable")
                units = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.string())], ["unit"])

    return docs.select("text").mapInArrow(tidy(run), "unit string").groupBy("unit").agg(F.count("*").alias("n"))


def best_path(edges: Column, size: Column) -> Column:
    """Ids on the best path through ``edges`` (start, end, score, id) over positions 0..size."""
    return scored_path(edges, size)["ids"]


def scored_path(edges: Column, size: Column) -> Column:
    """The best path as ``struct<ids, total>``, its ids and the sum of its scores."""
    origin = F.array(F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("back"), F.lit(0).alias("id")))
    arrive = lambda acc, e: F.struct((F.get(acc, e["start"])["total"] + e["score"]).alias("total"), F.negative(e["start"]).alias("back"), e["id"].alias("id"))
    table = F.aggregate(
        F.sequence(F.lit(1), size),
        origin.cast("array<struct<total:double,back:int,id:int>>"),
        lambda acc, at: F.concat(acc, F.array(F.array_max(F.transform(F.filter(edges, lambda e: e["end"] == at), lambda e: arrive(acc, e))))),
    )

    def walk(best: Column) -> Column:
        step = lambda acc: F.struct(F.negative(F.get(best, acc["at"])["back"]).alias("at"), F.concat(F.array(F.get(best, acc["at"])["id"]), acc["ids"]).alias("ids"))
        start = F.struct(size.alias("at"), F.array().cast("array<int>").alias("ids"))
        ids = F.aggregate(F.sequence(F.lit(1), size), start, lambda acc, _: F.when(acc["at"] > 0, step(acc)).otherwise(acc))["ids"]
        return F.struct(ids.alias("ids"), F.get(best, size)["total"].alias("total"))

    return let(table, walk)


def merged_path(edges: Column, size: Column) -> Column:
    """Ids after merging, from single characters on, the best-scored edge over two neighbouring symbols again and again.

    The state holds, for each position, the end of the symbol that starts there (-1: none does);
    an edge joins two symbols if the end of the end of its start is its own.
    """
    longer = F.filter(edges, lambda e: e["end"] - e["start"] > 1)

    def merge(ends: Column, best: Column) -> Column:
        middle = F.get(ends, best["start"])
        return F.transform(ends, lambda end, at: F.when(at == best["start"], best["end"]).when(at == middle, F.lit(-1)).otherwise(end))

    def fold(wide: Column) -> Column:
        def step(state: Column) -> Column:
            ends = state["ends"]
            fits = F.filter(wide, lambda e: F.get(ends, F.get(ends, e["start"])) == e["end"])
            # edges are sorted from the best on, so the first that fits is it
            after = lambda f: F.when(F.size(f) == 0, F.struct(ends.alias("ends"), F.lit(True).alias("done"))).otherwise(F.struct(let(F.get(f, F.lit(0)), lambda best: merge(ends, best)).alias("ends"), F.lit(False).alias("done")))
            return F.when(state["done"], state).otherwise(let(fits, after))

        start = F.struct(F.sequence(F.lit(1), size).alias("ends"), (F.size(wide) == 0).alias("done")).cast("struct<ends:array<int>,done:boolean>")
        return F.aggregate(F.sequence(F.lit(1), size), start, lambda acc, _: step(acc), lambda acc: acc["ends"])

    ordered = F.array_sort(F.transform(longer, lambda e: F.struct(F.negative(e["score"]).alias("cost"), e["start"].alias("start"), e["end"].alias("end"))))
    edge = lambda a, b: F.get(F.filter(edges, lambda e: (e["start"] == a) & (e["end"] == b)), F.lit(0))["id"]
    kept = let(let(ordered, fold), lambda ends: F.filter(F.transform(ends, lambda end, at: F.struct(at.alias("start"), end.alias("end"))), lambda x: x["end"] > 0))
    return F.transform(kept, lambda x: edge(x["start"], x["end"]))


def ranked_path(edges: Column, size: Column) -> Column:
    """What :func:`merged_path` gives, where no edge is of a late piece (:meth:`Pieces.late`): one look at each edge, from the best on.

    A symbol's parts were merged as they would be in a text of that symbol alone, so a new symbol lets
    only edges fit that are worse than its own: those passed by need no second look.
    """
    ordered = F.sort_array(F.transform(F.filter(edges, lambda e: e["end"] - e["start"] > 1), lambda e: F.struct(F.negative(e["score"]).alias("cost"), e["start"].alias("start"), e["end"].alias("end"))))

    def step(ends: Column, e: Column) -> Column:
        middle = F.get(ends, e["start"])
        merge = F.transform(ends, lambda end, at: F.when(at == e["start"], e["end"]).when(at == middle, F.lit(-1)).otherwise(end))
        return F.when(F.get(ends, middle) == e["end"], merge).otherwise(ends)

    ends = F.aggregate(ordered, F.sequence(F.lit(1), size), step)
    kept = let(ends, lambda ends: F.filter(edges, lambda e: F.get(ends, e["start"]) == e["end"]))
    return F.transform(F.sort_array(F.transform(kept, lambda e: F.struct(e["start"].alias("start"), e["id"].alias("id")))), lambda e: e["id"])


def encode_long(unit: str, table: dict[str, tuple[int, float]], longest: int, unknown: float, merges: bool) -> list[int]:
    """What the folds give for one unit: merges taken from a heap, or Viterbi with a look back of the longest piece."""
    spell = lambda c: table[c][0] if c in table else -ord(c)
    n = len(unit)
    if not merges:
        total, back = [0.0], [0]
        for end in range(1, n + 1):
            options = []
            for start in range(max(0, end - longest), end):
                found = table.get(unit[start:end])
                if found or end - start == 1:
                    options.append((total[start] + (found[1] if found else unknown), -start))
            best = max(options)
            total.append(best[0])
            back.append(-best[1])
        out, at = [], n
        while at:
            piece = unit[back[at] : at]
            out.append(table[piece][0] if piece in table else -ord(piece))
            at = back[at]
        return out[::-1]
    end, before = list(range(1, n + 1)), list(range(-1, n))  # by start of a symbol; before has the end's place too
    alive = [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(start: int) -> None:
        if end[start] < n:
            stop = end[end[start]]
            found = table.get(unit[start:stop]) if stop - start <= longest else None
            if found:
                heapq.heappush(heap, (-found[1], start, stop))

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
    return [table[unit[i : end[i]]][0] if end[i] - i > 1 else spell(unit[i]) for i in range(n) if alive[i]]


def _encode_long_units(units: DataFrame, pieces: Pieces, paths: bool) -> DataFrame:
    """``units(unit, n)`` with ``ids``, and with ``paths`` also ``path`` and ``path_score``."""
    table = {p: (i, s) for i, (p, s, ok) in enumerate(zip(pieces.pieces, pieces.scores, pieces.normal, strict=True)) if ok}
    sent = units.sparkSession.sparkContext.broadcast((table, pieces.longest, pieces.unknown_score, pieces.merges))

    scores = pieces.scores

    def run(batches):
        table, longest, unknown, merges = sent.value
        for batch in _slices(batches):
            units = batch.column(0).to_pylist()
            columns = [batch.column(0), batch.column(1), pa.array([encode_long(u, table, longest, unknown, merges) for u in units], pa.list_(pa.int32()))]
            if paths:
                best = [encode_long(u, table, longest, unknown, False) for u in units]
                columns += [pa.array(best, pa.list_(pa.int32())), pa.array([float(sum(scores[i] if i >= 0 else unknown for i in b)) for b in best], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["unit", "n", "ids", "path", "path_score"][: len(columns)])

    return units.mapInArrow(tidy(run), "unit string, n long, ids array<int>" + PATH * paths)


def encode_units(units: DataFrame, pieces: Pieces, parts: int, paths: bool = False) -> DataFrame:
    """``units(unit, n)`` with ``ids``; a character without a piece is minus its code point.

    With ``paths`` also Viterbi's ``path`` and its ``path_score``, whatever the model's kind.

    Units are dealt out before they explode, in ``parts`` parts, so that their edges need not be shuffled.
    """
    table = F.broadcast(pieces.table(units.sparkSession))  # the model's own fixed size
    units = units.select("unit", "n")
    length = F.length("unit")
    spots = F.explode(F.sequence(F.lit(0), length - 1)).alias("start")
    sized = F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), length - F.col("start")))).alias("len")
    dealt = units.filter(length <= LONG_UNIT).repartition(parts, "unit")
    parts = dealt.select("unit", "n", spots).select("unit", "n", "start", sized).withColumn("piece", F.col("unit").substr(F.col("start") + 1, F.col("len")))
    single = F.col("len") == 1
    edges = parts.join(table, "piece", "left").filter(F.col("id").isNotNull() | single)
    edge = F.struct("start", (F.col("start") + F.col("len")).alias("end"), F.coalesce("score", F.lit(pieces.unknown_score)).alias("score"), F.coalesce("id", F.negative(F.ascii("piece"))).alias("id"))
    # a number as the first key makes the sort of the edges cheap
    grouped = edges.groupBy(F.xxhash64("unit").alias("key"), "unit", "n").agg(F.collect_list(edge).alias("edges"), F.max("late").alias("late"))
    folds = [fold(F.col("edges"), F.length("unit")) for fold in ((merged_path, ranked_path) if pieces.merges else (best_path,))]
    ids = (F.when(F.col("late"), folds[0]).otherwise(folds[1]) if pieces.merges else folds[0]).alias("ids")
    if paths:
        # named in a step of its own, so that the fold runs once for both columns
        best = scored_path(F.col("edges"), F.length("unit")).alias("best")
        folded = grouped.select("unit", "n", ids, best).select("unit", "n", "ids", F.col("best.ids").alias("path"), F.col("best.total").alias("path_score"))
    else:
        folded = grouped.select("unit", "n", ids)
    return folded.unionAll(_encode_long_units(units.filter(length > LONG_UNIT), pieces, paths))


def _spelt(ids: list[int], byte_ids: list[int]) -> list[int]:
    if min(ids) >= 0:
        return ids
    return [k for i in ids for k in ([i] if i >= 0 else [byte_ids[b] for b in chr(-i).encode("utf-8", "surrogatepass")])]


def _packed(encoded: DataFrame, pieces: Pieces) -> tuple[np.ndarray, ...]:
    """Ascending unit hashes with begins and sizes of their ids, and the ids, of at most DICTIONARY rows: some 24 bytes a unit.

    Where ``encoded`` has paths, begins, sizes, ids and scores of these follow: some 24 bytes more.
    """
    byte_ids = pieces.byte_ids
    narrow = np.uint16 if len(pieces.pieces) <= 1 << 16 else np.int32
    paths = "path" in encoded.columns
    names = ("hash", "sizes", "flat", "path_sizes", "path_flat", "path_scores")[: 6 if paths else 3]
    kinds = (np.uint64, np.uint32, narrow, np.uint32, narrow, np.float64)

    def run(batches):
        for batch in batches:
            units = batch.column(0).to_pylist()
            points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            edges = np.concatenate(([0], np.cumsum([len(u) for u in units])))
            packed = [hash_words(points, edges[:-1], edges[1:])]
            for k in (1, 2)[: 1 + paths]:
                ids = [_spelt(i, byte_ids) for i in batch.column(k).to_pylist()]
                packed += [np.array([len(i) for i in ids], dtype=np.uint32), np.array([x for i in ids for x in i], dtype=narrow)]
            if paths:
                packed.append(batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], names)

    columns = ["unit", "ids", "path", "path_score"][: 4 if paths else 2]
    # a part at a time, so that the driver holds the arrays but not all results beside them
    parts: list[list[np.ndarray]] = [[np.zeros(0, kinds[k])] for k in range(len(names))]
    for row in encoded.select(*columns).mapInArrow(tidy(run), ", ".join(f"{n} binary" for n in names)).toLocalIterator():
        for k in range(len(names)):
            parts[k].append(np.frombuffer(bytes(row[k]), kinds[k]))
    hashes, sizes, flat, *more = (np.concatenate(parts[k]) for k in range(len(names)))
    del parts
    release()
    order = np.argsort(hashes, kind="stable")
    begins = lambda sizes: (np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.uint32)[order]
    out = (hashes[order], begins(sizes), sizes[order], flat)
    return (*out, begins(more[0]), more[0][order], more[1], more[2][order]) if paths else out


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begins[k] .. begins[k] + sizes[k] of all k, one after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def _lookup(dictionary, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the dictionary, whether it is there) of each hash."""
    known = dictionary[0]
    if not len(known):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    distinct, back = np.unique(hashes, return_inverse=True)
    at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
    return at[back], (known[at] == distinct)[back]


def encode(docs: DataFrame, model_path: str | None = None, dictionary: int = DICTIONARY, paths: bool = False) -> DataFrame:
    """``(doc_id, ids)`` of each row, with ``paths`` also Viterbi's ``path`` over the whole text and its ``path_score``."""
    docs, assemble = _assembly(docs, model_path, dictionary, paths)
    return docs.mapInArrow(tidy(assemble), RESULT + PATH * paths)


def round_trip(docs: DataFrame, model_path: str | None = None, dictionary: int = DICTIONARY, paths: bool = False) -> DataFrame:
    """What ``decode(encode(docs))`` gives, in one pass of one worker a task.

    With ``paths`` also ``n_path_ids``, ``path_crc32`` and ``path_score`` of Viterbi's path over the whole text.
    """
    docs, assemble = _assembly(docs, model_path, dictionary, paths)
    back = _decoder(docs.sparkSession, model_path)
    return docs.mapInArrow(tidy(lambda batches: back(assemble(batches))), DECODED + PATH_DIGEST * paths)


def _assembly(docs: DataFrame, model_path: str | None, dictionary: int, paths: bool = False):
    """The documents with what their assembly needs, and the function that assembles their batches."""
    spark = docs.sparkSession
    docs = require(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = Pieces.load(model_path or default_model())
    joints = pieces.joints()
    byte_ids = pieces.byte_ids
    units = cut(vocabulary(docs, joints))
    encoded = cut(encode_units(units, pieces, max(shuffle_partitions(spark), units.count() // UNITS_A_TASK), paths))
    size = encoded.count()
    frequent = encoded if size <= dictionary else most_frequent(encoded.withColumnRenamed("unit", "word"), dictionary).withColumnRenamed("word", "unit")
    sent = spark.sparkContext.broadcast((joints, _packed(frequent, pieces)))

    def rest(batches):
        """The units of each text that the dictionary lacks."""
        for batch in _slices(batches):
            keys = batch.column(0).to_pylist()
            for first, last, joined, points, starts, ends, bounds in unit_runs(batch.column(1).to_pylist(), sent.value[0]):
                hashes = hash_words(points, starts, ends)
                lost = ~_lookup(sent.value[1], hashes)[1]
                row = np.repeat(np.arange(last - first), np.diff(bounds))[lost]
                found = {(keys[first + r], joined[starts[i] : ends[i]]) for r, i in zip(row.tolist(), np.flatnonzero(lost).tolist(), strict=True)}
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], ["key", "unit"])

    def assemble(batches):
        joints, dictionary = sent.value
        for batch in _slices(batches):
            extra = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for first, last, joined, points, starts, ends, bounds in unit_runs(batch.column(1).to_pylist(), joints):
                hashes = hash_words(points, starts, ends)
                at, there = _lookup(dictionary, hashes)
                own: dict[str, list] = {}
                if not there.all():
                    for e in extra[first:last]:
                        own.update((x["unit"], [_spelt(x["ids"], byte_ids)] + ([_spelt(x["path"], byte_ids), x["path_score"]] if paths else [])) for x in e or ())
                missing = [own[joined[starts[i] : ends[i]]] for i in np.flatnonzero(~there)]
                columns = [batch.column(0).slice(first, last - first)]
                for k in (0, 1)[: 1 + paths]:
                    values, edges = filled(dictionary[1 + 3 * k : 4 + 3 * k], at, there, [m[k] for m in missing])
                    columns.append(pa.ListArray.from_arrays(pa.array(edges[bounds].astype(np.int32)), pa.array(values, pa.int32())))
                if paths:
                    scores = np.zeros(len(at))
                    scores[there], scores[~there] = dictionary[7][at[there]], [m[2] for m in missing]
                    row = np.repeat(np.arange(last - first), np.diff(bounds))
                    columns.append(pa.array(np.bincount(row, weights=scores, minlength=last - first).astype(np.float64)))  # of no units it counts in integers
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "path", "path_score"][: len(columns)])

    def filled(entries, at, there, missing):
        """The ids of all units one after another, from the dictionary's ``entries`` or else ``missing``, and where each unit's end."""
        begins, sizes, flat = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), entries[2]
        begins[there], sizes[there] = entries[0][at[there]], entries[1][at[there]]
        if missing:
            own = np.array([len(m) for m in missing])
            begins[~there], sizes[~there] = len(flat) + np.cumsum(own) - own, own
            flat = np.concatenate((flat, np.array([i for m in missing for i in m], dtype=np.int32)))
        return flat[_ranges(begins, sizes)], np.concatenate(([0], np.cumsum(sizes)))

    if size > dictionary:
        # rows of one key get the units of all of them, so equal keys do no harm
        key = F.coalesce("doc_id", F.xxhash64("text")).alias("key")
        lost = docs.select(key, "text").mapInArrow(tidy(rest), "key long, unit string").distinct().join(encoded.drop("n"), "unit")
        lost = lost.groupBy("key").agg(F.collect_list(F.struct(*encoded.drop("n").columns)).alias("extra"))
        docs = docs.select("doc_id", "text", key).join(lost, "key", "left").select("doc_id", "text", "extra")
    return docs, assemble


def decoded(ids: np.ndarray, pieces: list[str], byte_of: dict[int, int]) -> str:
    """The text of a sequence of ids: pieces joined, byte pieces as UTF-8, the first space dropped. Of many rows: :func:`decoded_rows`."""
    ids = ids.tolist()
    if byte_of.keys().isdisjoint(ids):
        text = "".join(map(pieces.__getitem__, ids)).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text
    out, held = [], bytearray()
    for i in ids:
        if i in byte_of:
            held.append(byte_of[i])
            continue
        if held:
            out.append(held.decode("utf-8", "replace"))
            held = bytearray()
        out.append(pieces[i])
    if held:
        out.append(held.decode("utf-8", "replace"))
    text = "".join(out).replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def spellings(pieces: list[str], byte_of: dict[int, int]) -> tuple[np.ndarray, ...]:
    """The UTF-8 bytes of all pieces one after another with spaces for their sign, where each begins, its size, and which are byte pieces."""
    spelt = [bytes([byte_of[i]]) if i in byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
    sizes = np.array([len(x) for x in spelt], dtype=np.int64)
    return np.frombuffer(b"".join(spelt), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes, np.isin(np.arange(len(pieces)), list(byte_of))


def decoded_rows(rows: list[np.ndarray], spelt: tuple[np.ndarray, ...]) -> list[bytes]:
    """What :func:`decoded` gives for each row, as UTF-8, the bytes of all rows gathered at once."""
    data, begins, sizes, spells = spelt
    ids = np.concatenate([np.zeros(0, np.int32), *rows])
    edges = np.cumsum([0, *map(len, rows)])
    joined = data[_ranges(begins[ids], sizes[ids])].tobytes()
    ends = np.concatenate(([0], np.cumsum(sizes[ids])))[edges].tolist()
    odd = np.diff(np.concatenate(([0], np.cumsum(spells[ids])))[edges]) > 0
    out = []
    for a, b, o in zip(ends[:-1], ends[1:], odd.tolist(), strict=True):
        text = joined[a:b]
        if o:  # byte pieces may spell anything
            text = text.decode("utf-8", "replace").replace(SPACE, " ").encode()
        out.append(text[1:] if text.startswith(b" ") else text)
    return out


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """``encoded(doc_id, ids)`` to ``(doc_id, n_ids, ids_crc32, decoded)``; null ids give an empty text.

    The crc32 is that of the ids as little-endian unsigned 32-bit integers.
    """
    return encoded.select("doc_id", "ids").mapInArrow(tidy(_decoder(encoded.sparkSession, model_path)), DECODED)


def _decoder(spark: SparkSession, model_path: str | None):
    pieces = Pieces.load(model_path or default_model())
    byte_of = {i: b for b, i in enumerate(pieces.byte_ids)}
    sent = spark.sparkContext.broadcast(spellings(pieces.pieces, byte_of))

    def run(batches):
        for batch in _slices(batches):
            rows = ids_of(batch.column(1))
            columns = [batch.column(0), *digest(rows), pa.array(decoded_rows(rows, sent.value), pa.string())]
            if batch.num_columns > 2:
                columns += [*digest(ids_of(batch.column(2))), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "ids_crc32", "decoded", "n_path_ids", "path_crc32", "path_score"][: len(columns)])

    def ids_of(column):
        return [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in column]

    def digest(rows):
        return pa.array([len(x) for x in rows], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in rows], pa.int64())

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text: ``n_ids``, the crc32 of the ids, the decoded text's digest, and Viterbi's path likewise with its score."""
    back = round_trip(documents(spark, sf_dir), paths=True)
    return back.select("doc_id", "n_ids", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "n_path_ids", "path_crc32", F.round("path_score", 6).alias("path_score"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the ids of every text."""
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")
