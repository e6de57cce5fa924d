"""Token ids in Parquet files: list columns, delta or dictionary pages, selective reads.

Documents are dealt by ranges of ``doc_id`` and sorted, each task encodes its range, and
Spark's Parquet writer makes one file a range, so that the files in name order hold
the documents in ascending id order. A file has ``doc_id`` and ``n_tokens`` (delta-packed
longs) beside ``ids`` (a list of ints, dictionary pages with a fall-back to delta packing),
row groups of ``ROW_GROUP`` bytes and pages of ``PAGE`` bytes with column indexes, so a reader
of some documents or of the lengths alone touches only their pages.

Encoding is the tokenizers library's. Pieces of the file's own splitting pattern are
encoded independently by it, so each distinct piece is given to the library once for many texts and
remembered by its 64-bit hash (at most ``REMEMBERED`` pieces a worker, then the memory starts anew).
Texts with apostrophes, which the pattern splits by more rules, go to the library whole. Strings of special
tokens in a text are ordinary text.

Defined results: null and empty texts hold only the end id. Rows with a null id are left out.
Repeated ids are written each, next to each other. Other columns are ignored. An empty table gives
empty files and no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import hash_words, tidy
from .runtime import documents, require, scratch

#: Characters that regular-expression libraries class differently as white space: such texts go to the library whole.
UNSURE = r"[\x1c-\x1f\x85᠎​-‍﻿]"
END_ID = 0
ROW_GROUP = 32 << 20
PAGE = 256 << 10
REMEMBERED = 1_500_000
RECENT = 1 << 15
#: Added to the kind of a character that UNSURE names.
ODD = 8
SLICE_ROWS = 512
GROUP_CHARS = 1 << 19
STRING = 256
SCHEMA = "doc_id long, n_tokens long, ids array<int>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces:
    """Ids of pieces by their hashes: sorted arrays, and shorter ones of the pieces met last, which join them when they have grown."""

    def __init__(self):
        self.parts = [self._none(), self._none()]
        self.flat = np.zeros(1 << 16, np.uint16)
        self.used = 0

    @staticmethod
    def _none() -> tuple[np.ndarray, ...]:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, whether it is known) of each hash."""
        begins, sizes, known = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        for have, begin, size in self.parts:
            if len(have):
                at = np.minimum(np.searchsorted(have, hashes), len(have) - 1)
                here = have[at] == hashes
                begins[here], sizes[here] = begin[at[here]], size[at[here]]
                known |= here
        return begins, sizes, known

    def add(self, hashes: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Remember ascending ``hashes`` that aren't known; their begins and sizes."""
        sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
        begins = (np.cumsum(sizes) - sizes + self.used).astype(np.uint32)
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))
        # two bytes an id for as long as all fit
        if self.flat.dtype == np.uint16 and len(flat) and flat.max() >= 1 << 16:
            self.flat = self.flat.astype(np.int32)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(len(flat) + self.used // 4 + (1 << 16), self.flat.dtype)))
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.parts[1] = self._merged(self.parts[1], (hashes, begins, sizes))
        if len(self.parts[1][0]) > RECENT + len(self.parts[0][0]) // 8:
            self.parts = [self._merged(*self.parts), self._none()]
        return begins, sizes

    @staticmethod
    def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        order = np.argsort(np.concatenate((a[0], b[0])), kind="stable")
        return tuple(np.concatenate(x)[order] for x in zip(a, b, strict=True))


class Encoder:
    """A tokenizer with a memory of pieces; ``spec`` is the text of its file."""

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True
        split = json.loads(spec).get("pre_tokenizer") or {}
        self.splits = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not json.loads(spec).get("normalizer")
        self.unsure = regex.compile(UNSURE).match
        self.classes = [regex.compile(c).match for c in (r"\p{L}", r"\p{N}", r"\s")]
        self.kinds = np.full(0x110000, 255, dtype=np.uint8)
        self.memory = Pieces()

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        """0 letter, 1 number, 2 white space, 3 other, and ODD more if UNSURE names it; looked up once for each character met."""
        kind = self.kinds[points]
        if (kind == 255).any():
            for c in np.unique(points[kind == 255]).tolist():
                self.kinds[c] = next((k for k, test in enumerate(self.classes) if test(chr(c))), 3) + (ODD if self.unsure(chr(c)) else 0)
            kind = self.kinds[points]
        return kind

    @staticmethod
    def _starts(points: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pattern's pieces start, for texts without apostrophes: runs of one kind, the last white space
        before other characters apart, and, if it is a space, joined to what follows."""
        begins = np.ones(len(points), dtype=bool)
        begins[1:] = kind[1:] != kind[:-1]
        own = np.zeros(len(points) + 1, dtype=bool)
        own[offsets] = True
        begins |= own[:-1]
        after = np.flatnonzero(begins[1:] & ~own[1:-1] & (kind[1:] != 2) & (kind[:-1] == 2)) + 1
        begins[after - 1] = True
        begins[after[points[after - 1] == 0x20]] = False
        return np.flatnonzero(begins)

    def _new_ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces; those that begin with a space go to the library strung together, as words of longer texts."""
        out: list[list[int] | None] = [None] * len(pieces)
        strung = [i for i, p in enumerate(pieces) if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        runs = [strung[k : k + STRING] for k in range(0, len(strung), STRING)]
        made = self.library.encode_batch(["".join([pieces[i] for i in run]) for run in runs], add_special_tokens=False)
        for run, e in zip(runs, made, strict=True):
            ids, words = e.ids, np.array(e.word_ids, dtype=np.int64)
            cuts = np.searchsorted(words, np.arange(len(run) + 1)).tolist()
            if len(words) and words[-1] == len(run) - 1:
                for k, i in enumerate(run):
                    out[i] = ids[cuts[k] : cuts[k + 1]]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._library([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        kind = self._kinds(points)
        odd = np.flatnonzero(kind >= ODD) if self.splits else offsets[:0]
        odd = set((np.searchsorted(offsets, odd, side="right") - 1).tolist())
        whole = [i for i, t in enumerate(texts) if not self.splits or "'" in t or i in odd]
        if whole:
            parts = [np.zeros(0, np.int32)] * len(texts)
            for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
                parts[i] = np.array(ids, dtype=np.int32)
            rest = sorted(set(range(len(texts))) - set(whole))
            flat, sizes = self.encode([texts[i] for i in rest]) if rest else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            for i, part in zip(rest, np.split(flat, np.cumsum(sizes)[:-1]) if rest else [], strict=True):
                parts[i] = part
            return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        starts = self._starts(points, kind, offsets)
        ends = np.append(starts[1:], len(points))
        hashes = hash_words(points, starts, ends)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.memory) + len(distinct) > REMEMBERED:
            self.memory = Pieces()
        begins, sizes, known = self.memory.find(distinct)
        new = np.flatnonzero(~known)
        if len(new):
            begin, end = starts[first[new]].tolist(), ends[first[new]].tolist()
            begins[new], sizes[new] = self.memory.add(distinct[new], self._new_ids([joined[a:b] for a, b in zip(begin, end, strict=True)]))
        begins, sizes = begins[back], sizes[back]
        stops = np.concatenate(([0], np.cumsum(sizes)))
        places = np.arange(stops[-1]) + np.repeat(begins - stops[:-1], sizes)
        return self.memory.flat[places], np.diff(stops[np.searchsorted(starts, offsets)])


@functools.lru_cache(maxsize=1)
def encoder_of(spec: str) -> Encoder:
    """One encoder a worker process, so that its memory of pieces serves all its tasks."""
    return Encoder(spec)


def _groups(texts: list[str], chars: int = GROUP_CHARS):
    """Runs (first, last) of texts with about so many characters."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > chars:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int | None = END_ID) -> None:
    """Encode ``docs(doc_id, text)`` into Parquet files under ``path``, in ascending doc_id order."""
    spark = docs.sparkSession
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as file:  # the driver's own copy of the vocabulary
        sent = spark.sparkContext.broadcast(file.read())

    def run(batches):
        encoder = encoder_of(sent.value)
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for first, last in _groups(texts):
                    values, sizes = encoder.encode(texts[first:last])
                    if end_id is not None:
                        values = np.insert(values, np.cumsum(sizes), end_id)
                        sizes = sizes + 1
                    edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(first, last - first), pa.array(sizes), pa.ListArray.from_arrays(pa.array(edges), pa.array(values.astype(np.int32)))], ["doc_id", "n_tokens", "ids"])

    rows = require(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(tidy(run), SCHEMA)
    writer = rows.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true")
    writer.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.dictionary.page.size", 1 << 20).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, doc_id, n_tokens, ids)`` of the files under ``path``."""
    return spark.read.schema(SCHEMA).parquet(path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "n_tokens", "ids")


def token_offsets(rows: DataFrame) -> DataFrame:
    """``(file, doc_id, n_tokens, ...)`` with ``start``: how many ids the documents before it have.

    Lengths are summed by file first; only these sums, one a file, pass through a single task.
    """
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("low"))
    before = sums.withColumn("before", F.coalesce(F.sum("tokens").over(Window.orderBy("low", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file", "before")
    order = Window.partitionBy("file").orderBy("doc_id", "turn").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("turn", F.monotonically_increasing_id())  # the place in the file among equal ids
    return ranked.withColumn("inside", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(before, "file").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside", "turn")


def token_digests(rows: DataFrame) -> DataFrame:
    """``(file, doc_id, n_tokens, ids_crc32)`` from the ids themselves."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            edges = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, int)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(), dtype="<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(edges).astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "n_tokens", "ids_crc32"])

    return rows.select("file", "doc_id", "ids").mapInArrow(tidy(run), "file string, doc_id long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), path)
    return token_offsets(token_digests(read_token_files(spark, path))).select("doc_id", "start", "n_tokens", "ids_crc32")
