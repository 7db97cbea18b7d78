"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Features of a text are its words and punctuation runs, pairs of them, and runs of one to three word
shapes, hashed into a fixed number of coordinates; a coordinate's value is its share of the text's
n-grams of that kind. A score is the sparse dot product of these with the weights, through the
logistic function. Training follows the regularised leader coordinate by coordinate, in passes over
a bounded sample of labelled rows; scoring maps over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash

BITS = 18
#: Labelled rows that the model is fitted on: those with the smallest hashes of their doc_id.
MAX_LABELLED = 8_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.002, 0.001
SCALE = 16.0
THRESHOLD = 0.3
#: Kinds of n-grams: words or shapes, and how many.
KINDS = (("words", 1), ("words", 2), ("shapes", 1), ("shapes", 2), ("shapes", 3))
SLICE_CHARS = 1_000_000


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates and values of the n-grams of some texts, one after another, and where each text's begin."""
    data, starts = wordhash.join([t.encode() for t in texts])
    words, shapes, at = wordhash.tokens(data, starts)
    counts = np.diff(at)
    mask = np.uint64((1 << BITS) - 1)
    parts = []
    for salt, (what, n) in enumerate(KINDS):
        sizes = np.maximum(counts - n + 1, 0)
        upto = np.cumsum(sizes)
        index = np.arange(upto[-1] if len(upto) else 0) + np.repeat(at[:-1] - (upto - sizes), sizes)
        h = wordhash.ngrams(words if what == "words" else shapes, n)[index] if len(words) else np.zeros(0, np.uint64)
        parts.append((np.repeat(np.arange(len(texts)), sizes), (wordhash.mix(h + np.uint64(salt + 1)) & mask).astype(np.int64), np.repeat(SCALE / np.maximum(sizes, 1), sizes)))
    row = np.concatenate([p[0] for p in parts])
    order = np.argsort(row, kind="stable")
    return np.concatenate([p[1] for p in parts])[order], np.concatenate([p[2] for p in parts])[order], np.searchsorted(row[order], np.arange(len(texts) + 1))


class Ftrl:
    """FTRL-proximal logistic regression over 2^BITS coordinates and a bias."""

    def __init__(self, size: int = (1 << BITS) + 1):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The weights that the sums so far lead to."""
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        """Learn from one example with distinct coordinates."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(texts: list[str], labels: list[int]) -> np.ndarray:
    """Weights, the bias last, from texts in the order given."""
    model, rows = Ftrl(), []
    for i in range(0, len(texts), 200):
        at, x, starts = features(texts[i : i + 200])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            own, place = np.unique(at[a:b], return_inverse=True)
            rows.append((np.append(own, 1 << BITS), np.append(np.bincount(place, x[a:b], len(own)), 1.0)))
    for _ in range(EPOCHS):
        for (at, x), y in zip(rows, labels, strict=True):
            model.update(at, x, y)
    return model.weights().astype(np.float32)


def score_texts(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1; a text without words has the bias's score."""
    at, x, starts = features(texts)
    # Each text's own sum, so that a score does not depend on the texts beside it.
    some = np.flatnonzero(np.diff(starts))
    sums = np.zeros(len(texts))
    if len(some):
        sums[some] = np.add.reduceat(weights[at] * x, starts[some])
    return 1 / (1 + np.exp(-np.clip(sums + weights[-1], -35, 35)))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Fit on at most MAX_LABELLED labelled rows of docs that are not held out.

    Null labels are left out; a doc_id with several labels has the lowest. One task fits the model on
    the bounded sample, whatever the table's size; without labelled rows all weights are 0.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")  # MAX_LABELLED rows at most
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(MAX_LABELLED).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            ys += batch.column("y").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, ys).tobytes()], pa.binary())], ["weights"])

    got = rows.select("text", "y").mapInArrow(run, "weights binary").first()
    return np.frombuffer(bytes(got[0]), np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """Adds a column name to docs, which needs a column text; null texts score as empty ones. Extra columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^BITS numbers, whatever the data
    kept = docs.schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(kept.index("text")).to_pylist()]
            out, i = [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE_CHARS):
                    size += len(texts[j])
                    j += 1
                out.append(score_texts(texts[i:j], w))
                i = j
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], [*kept, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that score THRESHOLD or more, with the columns of docs."""
    name = "score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return score(docs, train(docs, labels), name).where(F.col(name) >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document with a model of labels.quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, weights).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
