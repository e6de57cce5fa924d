"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs that skip one
word (lower case, runs of letters and digits). FTRL-proximal (McMahan et al. 2013) has a
learning rate for each coordinate and an L1 term that leaves most weights at exactly
zero, so the model is a short list of ``(feature, weight)`` that fits in a broadcast
(``2**BITS`` entries at most).

Training takes the ``MAX_TRAIN`` labelled rows with the smallest id hashes (a
documented bound; all of them where there are fewer); their features are made by all
tasks and learnt in one. Scoring covers every document in one map-only pass.

Defined results: null, empty and wordless texts get the score of the intercept alone.
Repeated rows are scored each, and so are rows with a null id (never held out, never learnt from; the stage can't name them and keeps them). A doc_id with several labels counts as toxic if one of
them says so; null labels are left out. With no labelled rows, or labels of one kind only,
the model is that of the rows it has (all zero without any: score 0.5). Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import ALNUM, mix, pieces, release, tidy, words_of
from .runtime import documents, require, sized, table, with_row

BITS = 20
MAX_TRAIN = 12_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.1
HOLD_OUT = (3, 1)
THRESHOLD = 0.7
_PAIR = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def in_hold_out(doc_id: Column, hold_out: tuple[int, int]) -> Column:
    """Whether crc32 of the id as text has that remainder."""
    mod, rest = hold_out
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def feature_ids(texts: pa.Array):
    """(first row, last row, row of each feature, feature) by pieces of the batch; features can repeat."""
    shift = np.uint64(64 - BITS)
    for first, last, data, offsets in pieces(texts):
        words, bounds = words_of(data, offsets, ALNUM)
        row = np.repeat(np.arange(last - first), np.diff(bounds))
        rows, ids = [row], [mix(words) >> shift]
        for gap, (a, b) in ((1, _PAIR[:2]), (2, _PAIR[2:])):
            if len(words) > gap:
                same = row[gap:] == row[:-gap]
                rows.append(row[gap:][same])
                ids.append(mix(words[:-gap][same] * a + words[gap:][same] * b) >> shift)
        yield first, last, np.concatenate(rows), np.concatenate(ids).astype(np.int64)


def _examples(rows: DataFrame) -> DataFrame:
    """(doc_id, label, features) with each feature of a text once."""

    def run(batches):
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last, row, feature in feature_ids(batch.column(2)):
                keys = np.unique(row << BITS | feature)
                cuts = np.searchsorted(keys, np.arange(last - first + 1) << BITS)
                found = [(keys[cuts[i] : cuts[i + 1]] & ((1 << BITS) - 1)).astype(np.int32).tobytes() for i in range(last - first)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[first:last], pa.int64()), pa.array(labels[first:last], pa.int32()), pa.array(found, pa.binary())], ["doc_id", "label", "features"])

    return rows.select("doc_id", "label", "text").mapInArrow(tidy(run), "doc_id long, label int, features binary")


class Ftrl:
    """State of the per-coordinate learner; coordinate 0 is the intercept."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, features: np.ndarray, label: int) -> None:
        w = self.weights(features)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[features]
        self.z[features] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[features] = n + g * g


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The int arrays of a binary column, without copies."""
    out = []
    for chunk in column.chunks:
        edges = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = chunk.buffers()[2]
        out += [np.frombuffer(data, np.int32, (b - a) // 4, a) if b > a else np.zeros(0, np.int32) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return out


def _learn(group: pa.Table) -> pa.Table:
    order = np.argsort(group.column("turn").to_numpy(), kind="stable")
    labels, features = group.column("label").to_pylist(), _views(group.column("features"))
    model = Ftrl(1 + (1 << BITS))
    for _ in range(EPOCHS):
        for i in order:
            model.learn(np.concatenate(([0], features[i] + 1)), labels[i])
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    out = pa.table([pa.array(at), pa.array(w[at])], ["feature", "weight"])
    del model, features
    release()
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", hold_out: tuple[int, int] | None = HOLD_OUT, max_train: int = MAX_TRAIN) -> dict[int, float]:
    """``{feature: weight}`` (0: intercept) learnt from at most ``max_train`` labelled rows."""
    rows = require(labels, "doc_id", label_col).filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    if hold_out:
        rows = rows.filter(~in_hold_out(F.col("doc_id"), hold_out))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = require(docs, "doc_id", "text").join(F.broadcast(rows), "doc_id")  # max_train small rows
    examples = _examples(texts).withColumns({"turn": F.xxhash64("doc_id"), "learner": F.lit(0)})
    learnt = examples.groupBy("learner").applyInArrow(_learn, "feature long, weight double")  # max_train rows
    return {r.feature: r.weight for r in learnt.collect()}  # at most 2**BITS + 1 sparse weights


def score(docs: DataFrame, model: dict[int, float]) -> DataFrame:
    """``(doc_id, score)`` of each row."""
    weights = np.zeros(1 << BITS)
    for feature, w in model.items():
        if feature:
            weights[feature - 1] = w
    at = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at]))
    bias = model.get(0, 0.0)

    def run(batches):
        own = np.zeros(1 << BITS)
        own[sent.value[0]] = sent.value[1]
        used = own != 0
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, last, row, feature in feature_ids(batch.column(1)):
                hit = used[feature]
                keys = np.unique(row[hit] << BITS | feature[hit])
                out[first:last] = np.bincount(keys >> BITS, weights=own[keys & ((1 << BITS) - 1)], minlength=last - first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out + bias, -30, 30))))], ["doc_id", "score"])

    return require(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; learns from rows that aren't held out."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", in_hold_out(F.col("doc_id"), HOLD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows scored as toxic go, whatever their ids."""
    rows = with_row(docs)
    scored = score(rows.select(F.col("_row").alias("doc_id"), "text"), fit(docs, table(spark, sf_dir, "labels")))
    bad = scored.filter(F.col("score") >= THRESHOLD).select(F.col("doc_id").alias("_row"))
    return rows.join(sized(bad), "_row", "left_anti").select(*docs.columns)
