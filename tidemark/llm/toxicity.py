"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training uses as many rows of either class and features of at least ``MIN_DOCS`` of its rows.
Features are the distinct words, pairs, and pairs with one word between of a whole text, hashed
to ``2**BITS`` slots; words are lower-cased (ASCII) without outer punctuation. Training runs on
the driver over a bounded sample of labelled rows, as arrays of slot numbers made on the
executors: ``SAMPLE_DOCS`` of each class, those with the smallest id hashes, as long as they come
to no more than ``SAMPLE_CHARS`` characters. Per-coordinate rates and L1 leave few non-zero
weights, which are broadcast as slots and values.

Classes are trained at equal numbers, so the bias is set afterwards: on every fifth row, which a
model of the others scores, it is moved to the least weighted log loss, a class counting by its
share of all labels.

Defined cases: a null or empty text has no features, so its score is that of the bias; a very
long text is scored whole, one over ``SAMPLE_CHARS`` is not learnt from; labels that are null are
not learnt from; a document with both labels counts for both; repeated documents are scored each
and learnt from once; extra columns are ignored; without labels of both classes every score is 0.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import label_bucket, mix, slices

BITS = 20
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 20_000_000
EPOCHS = 10
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0
MIN_DOCS = 3
OUTER = b".,;:!?\"'()[]{}|*_-"


class _Words(dict):
    """Hash of each word seen by a worker; forgets all when it gets large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.strip(OUTER))
        return value


_words = _Words()


def slots(text: str | None) -> np.ndarray:
    """Slot numbers of a text's features, with repetitions."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    shift, by = np.uint64(64 - BITS), np.uint64(0x9E3779B97F4A7C15)
    parts = [mix(h)]
    if len(h) > 1:
        parts.append(mix(h[:-1] * by + h[1:]))
    if len(h) > 2:
        parts.append(mix((h[:-2] * by + h[2:]) ^ np.uint64(0x5851F42D4C957F2D)))
    return (np.concatenate(parts) >> shift).astype(np.int32)


class Ftrl:
    def __init__(self):
        self.z, self.n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)  # the last is the bias

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 2**BITS)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


class Weights:
    """Non-zero weights by slot, and the bias (None: nothing was learnt)."""

    def __init__(self, at: np.ndarray, values: np.ndarray, bias: float | None):
        self.at, self.values, self.bias, self.dense = at, values, bias, None

    def __getstate__(self):
        return {**self.__dict__, "dense": None}

    def sum(self, slots_: np.ndarray) -> float:
        if self.dense is None:
            self.dense = np.zeros(2**BITS, np.float32)
            self.dense[self.at] = self.values
        found = self.dense[slots_]
        at = np.unique(slots_[found != 0])
        return float(self.dense[at].sum(dtype=np.float64)) + self.bias


def fit(examples: list[tuple[np.ndarray, int]]) -> Weights:
    """FTRL over the examples in a seeded order, ``EPOCHS`` times."""
    common = np.bincount(np.concatenate([at for at, _ in examples]), minlength=2**BITS) >= MIN_DOCS
    kept, model = [(at[common[at]], y) for at, y in examples], Ftrl()
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(kept)):
            model.learn(*kept[i])
    weights = model.weights().astype(np.float32)
    at = np.flatnonzero(weights[:-1])
    return Weights(at.astype(np.int32), weights[at], float(weights[-1]))


def shift(sums: np.ndarray, labels: np.ndarray, share: float) -> float:
    """What to add to the sums so that the weighted log loss is least; the classes count as
    ``share`` and 1 - ``share``, with a row at zero in each so that it stays finite."""
    sums, labels = np.append(sums, [0.0, 0.0]), np.append(labels, [0, 1])
    weight = np.where(labels == 1, share / (labels == 1).sum(), (1 - share) / (labels == 0).sum())
    low, high = -20.0, 20.0
    for _ in range(60):  # the loss's slope grows with the shift
        mid = (low + high) / 2
        slope = (weight * (1 / (1 + np.exp(-np.clip(sums + mid, -35, 35))) - labels)).sum()
        low, high = (mid, high) if slope < 0 else (low, mid)
    return (low + high) / 2


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Weights:
    """Weights from ``labels`` (doc_id, toxic) joined to ``docs`` (doc_id, text)."""
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    chosen = known.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample_docs).drop("_r")
    sized = docs.select("doc_id", "text").where("doc_id IS NOT NULL").join(F.broadcast(chosen), "doc_id").withColumn("_n", F.coalesce(F.length("text"), F.lit(0)))
    sized = sized.where(F.col("_n") <= SAMPLE_CHARS).dropDuplicates(["doc_id", "toxic"])
    upto = F.sum("_n").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    featured = F.pandas_udf(lambda s: pd.Series([np.unique(slots(t)).astype("<i4").tobytes() for t in s]), T.BinaryType())  # a number in Python takes ten times the space
    rows = sized.withColumn("_upto", upto).where(F.col("_upto") <= SAMPLE_CHARS).select("doc_id", "toxic", featured("text").alias("at")).toPandas()
    if rows["toxic"].nunique() < 2:
        return Weights(np.empty(0, np.int32), np.empty(0, np.float32), None)
    rows = rows.sort_values(["toxic", "doc_id"]).groupby("toxic").head(rows["toxic"].value_counts().min())
    examples = [(np.frombuffer(at, "<i4"), int(y)) for at, y in zip(rows["at"], rows["toxic"])]
    model = fit(examples)
    if len(examples) >= 10:
        first = fit([e for i, e in enumerate(examples) if i % 5])
        aside = examples[::5]
        model.bias += shift(np.array([first.sum(at) for at, _ in aside]), np.array([y for _, y in aside]), counts[1] / sum(counts.values()))
    return model


def probability(text: str | None, weights: Weights) -> float:
    if weights.bias is None:
        return 0.0
    return float(1 / (1 + np.exp(-np.clip(weights.sum(slots(text)), -35.0, 35.0))))


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id and the probability that a text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # as many as L1 leaves, of 2**BITS at most

    def run(batches):
        for batch in slices(batches):
            found = [probability(t, shared.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id="doc_id"):
    return F.coalesce(label_bucket(F.col(doc_id), 5) == 0, F.lit(False))
