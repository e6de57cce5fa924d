"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

1. *Random indexing* (Kanerva et al. 2000) over all documents: tokens (runs of letters and
   digits, runs of signs; case counts) are hashed to ``2**WORD_BITS`` buckets, each bucket has
   a fixed sparse ternary index vector, and a bucket's vector is the sum of the index vectors
   of its neighbours within two tokens. Each task adds up its own fixed-size table,
   and the tables are added by blocks of buckets.
2. A document is the mean of its tokens' unit vectors.
3. A network with one hidden layer (numpy) learns the label from at most ``MAX_TRAIN``
   labelled rows, a documented bound; a fifth of them is left for the temperature that
   calibrates its probabilities.

Defined results: null, empty and tokenless texts are the zero vector, and get
its score. Repeated rows are scored each, and so are rows with a null id (never held out, never learnt from). A doc_id with several labels takes the largest;
null labels are left out. Without labelled rows every score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import ALNUM, NOT_SPACE, hash_words, pieces, tidy, word_spans
from .runtime import documents, require, table
from .toxicity import in_hold_out

WORD_BITS = 15
DIMENSIONS = 32
NONZERO = 4
WINDOW = 2
BLOCKS = 64
HIDDEN = 16
MAX_TRAIN = 20_000
STEPS = 600
HOLD_OUT = (5, 0)
THRESHOLD = 0.3


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    random = np.random.default_rng(20)
    size = (1 << WORD_BITS, NONZERO)
    return random.integers(0, DIMENSIONS, size), random.choice([-1.0, 1.0], size)


def token_buckets(texts: pa.Array):
    """(first row, last row, row of each token, bucket) by pieces of the batch."""
    signs = NOT_SPACE & ~ALNUM
    for first, last, data, offsets in pieces(texts):
        words, marks = word_spans(data, offsets, ALNUM), word_spans(data, offsets, signs)
        starts, ends = np.concatenate((words[0], marks[0])), np.concatenate((words[1], marks[1]))
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        bucket = (hash_words(data, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        yield first, last, np.searchsorted(offsets, starts, side="right") - 1, bucket


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The unit vector of each bucket, from the neighbours of its tokens in all documents."""
    buckets = 1 << WORD_BITS

    def count(batches):
        place, sign = index_vectors()
        total = np.zeros(buckets * DIMENSIONS)
        for batch in batches:
            for _, _, row, bucket in token_buckets(batch.column(0)):
                for gap in range(1, WINDOW + 1):
                    same = row[gap:] == row[:-gap]
                    left, right = bucket[:-gap][same], bucket[gap:][same]
                    for a, b in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            total += np.bincount(a * DIMENSIONS + place[b, k], weights=sign[b, k], minlength=len(total))
        parts = total.astype(np.int64).reshape(BLOCKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(part, np.int64)
                sums[block] = sums[block] + part if block in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "sums"])

    schema = "block int, sums binary"
    rows = docs.select("text").mapInArrow(tidy(count), schema).repartition("block").mapInArrow(tidy(add), schema).collect()  # BLOCKS rows of fixed size
    out = np.zeros((BLOCKS, buckets * DIMENSIONS // BLOCKS))
    for r in rows:
        out[r.block] = np.frombuffer(r.sums, np.int64)
    out = out.reshape(buckets, DIMENSIONS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The mean token vector of each text; zero without tokens."""
    out = np.zeros((len(texts), DIMENSIONS))
    for first, last, row, bucket in token_buckets(texts):
        n = np.bincount(row, minlength=last - first)
        starts = np.concatenate(([0], np.cumsum(n)))
        full = np.flatnonzero(n)
        if len(full):
            out[first + full] = np.add.reduceat(vectors[bucket], starts[full], axis=0, dtype=np.float64) / n[full, None]
    return out


@dataclass
class Network:
    """Standardised input, a tanh layer, a logit, and the temperature it is divided by."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss of four fifths of the rows; the temperature from the rest."""
    random = np.random.default_rng(7)
    net = Network(x.mean(0) if len(x) else np.zeros(DIMENSIONS), x.std(0) + 1e-6 if len(x) else np.ones(DIMENSIONS), random.normal(0, 1 / np.sqrt(DIMENSIONS), (DIMENSIONS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if not len(x):
        return net
    rest = np.arange(len(x)) % 5 == 4
    if not rest.any() or rest.all():
        rest = np.zeros(len(x), dtype=bool)
    a, t = (x[~rest] - net.centre) / net.scale, y[~rest]
    names = ("w1", "b1", "w2", "b2")
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    for step in range(1, STEPS + 1):
        hidden = np.tanh(a @ net.w1 + net.b1)
        g = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30))) - t) / len(t)
        back = np.outer(g, net.w2) * (1 - hidden**2)
        for k, d in zip(names, (a.T @ back + 1e-4 * net.w1, back.sum(0), hidden.T @ g + 1e-4 * net.w2, g.sum()), strict=True):
            m, v = moments[k]
            moments[k] = m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
            setattr(net, k, getattr(net, k) - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    if rest.any():
        z, t = net.logits(x[rest]), y[rest]
        net.temperature = min(np.geomspace(0.25, 8, 61), key=lambda k: float(np.mean(np.logaddexp(0, np.where(t == 1, -z, z) / k))))
    return net


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", hold_out: tuple[int, int] | None = HOLD_OUT, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, Network]:
    docs = require(docs, "doc_id", "text")
    vectors = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = require(labels, "doc_id", label_col).filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(label_col).cast("double").alias("label"))
    if hold_out:
        rows = rows.filter(~in_hold_out(F.col("doc_id"), hold_out))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def embed(batches):
        for batch in batches:
            x = pooled(batch.column(2), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    texts = docs.join(F.broadcast(rows), "doc_id").select("doc_id", "label", "text")  # max_train small rows
    got = sorted(texts.mapInArrow(tidy(embed), "doc_id long, label double, x binary").collect())  # max_train short vectors
    order = np.random.default_rng(3).permutation(len(got))
    x = np.array([np.frombuffer(got[i].x) for i in order]).reshape(-1, DIMENSIONS)
    return vectors, train(x, np.array([got[i].label for i in order]))


def score(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """``(doc_id, score)`` of each row."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches):
        own, model = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probabilities(pooled(batch.column(1), own)))], ["doc_id", "score"])

    return require(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; learns labels only from rows that aren't held out."""
    scored = score(docs, *fit(docs, labels))
    return scored.select("doc_id", in_hold_out(F.col("doc_id"), HOLD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
