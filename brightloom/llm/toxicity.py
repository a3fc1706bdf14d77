"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and pairs around a word.

A feature is the presence of a word n-gram in a document, hashed into 2^BITS slots. Words are runs of letters, digits and
non-ASCII characters, A-Z in lower case. Each coordinate has its own rate, which falls with the gradients that it has seen,
and L1 keeps a weight at zero until several documents agree on it; so the weights that are sent out are few.

The model is learned from a bounded sample of labelled documents (SAMPLE of either label, chosen by a hash of doc_id, whole
texts, up to FEATURES slots of either label in all) in one task that goes over them EPOCHS times. Small samples have a lower
L1. Scoring covers whole texts of all rows.

Defined results: null counts as empty, and an empty text has the score of a text without any known feature. Labels other
than 0 and 1, and ids with both, aren't learned from; of rows that repeat an id one is. Without both labels the score is 1 if
all labels are 1, else 0. Rows that repeat get equal results; a null doc_id isn't held out and isn't learned from; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, mix, prepare, texts_of, trimmed
from .linear import among_first
from .words import NON_WORD, word_hashes

BITS = 20
#: Documents and feature slots of either label in the sample.
SAMPLE, FEATURES = 4000, 12_000_000
#: The rate's scale and start, penalties, passes, and the sample's size from which the full L1 counts.
ALPHA, BETA, L1, L2, EPOCHS, FULL = 1.0, 1.0, 20.0, 0.0, 8, 3000
#: Words between the two of a pair, and a factor that tells such pairs apart.
PAIRS = ((1, 3), (2, 5))


def slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, number of its text) of each word and pair of words."""
    h, counts = word_hashes(texts, NON_WORD)
    text = np.repeat(np.arange(len(texts)), counts)
    found, of = [h], [text]
    for far, factor in PAIRS:
        inside = text[:-far] == text[far:]
        found.append(mix((h[:-far] * np.uint64(factor) + h[far:])[inside]))
        of.append(text[:-far][inside])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(of)


class Ftrl:
    """Weights over 2^BITS slots and, at the last place, a bias without L1."""

    def __init__(self, l1: float, size: int = 1 << BITS):
        self.z, self.n, self.l1 = np.zeros(size + 1), np.zeros(size + 1), l1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        least = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= least, 0.0, (np.sign(z) * least - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        """One document with the given distinct slots."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label) * weight
        after = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = after


def fit(rows: list[tuple[int, np.ndarray]]) -> Ftrl:
    """From (label, distinct slots), in an order that is drawn anew for each pass; the rarer label weighs as much as the other."""
    counts = np.bincount([y for y, _ in rows], minlength=2)
    model = Ftrl(L1 * min(1.0, np.sqrt(len(rows) / FULL)))
    weight = counts.max() / np.maximum(counts, 1)
    draw = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for k in draw.permutation(len(rows)).tolist():
            model.learn(rows[k][1], rows[k][0], float(weight[rows[k][0]]))
    return model


@dataclass
class Weights:
    """The slots whose weight isn't zero, and the bias."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: list[str], dense: np.ndarray) -> np.ndarray:
        """dense: the same weights by slot."""
        found, of = slots(texts)
        hit = np.flatnonzero(dense[found])
        once = np.unique(of[hit].astype(np.int64) << BITS | found[hit])
        total = np.bincount(once >> BITS, dense[once & ((1 << BITS) - 1)], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.slot] = self.weight
        return out


def learn(documents: DataFrame, labels: DataFrame) -> Weights:
    """From documents (doc_id, text) and labels (doc_id, toxic)."""
    spark = prepare(documents.sparkSession)
    told = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    told = told.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}  # two rows
    picked = [r for y in sorted(counts) for r in told.where((F.col("label") == y) & among_first(F.col("doc_id"), SAMPLE, counts[y])).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]  # SAMPLE rows
    if len(counts) < 2:
        return Weights(np.zeros(0, np.int32), np.zeros(0), 60.0 if 1 in counts else -60.0)
    kind = "doc_id long, label int, slots binary"

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            found, of = slots(texts_of(b.column(1)))
            once = np.unique(of.astype(np.int64) << BITS | found)
            cut = np.searchsorted(once, np.arange(b.num_rows + 1, dtype=np.int64) << BITS)
            own = (once & ((1 << BITS) - 1)).astype(np.int32)
            yield pa.record_batch([b.column(0), b.column(2), pa.array([own[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], schema=arrow(kind))

    def fitted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], [0, 0]
        for b in parts:
            for y, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                at = np.frombuffer(raw, np.int32)
                held[y] += len(at)
                if held[y] <= FEATURES:
                    rows.append((y, at))
        if rows:
            model = fit(rows)
            w = model.weights(np.arange(len(model.z)))
            some = np.append(np.flatnonzero(w[:-1]), len(w) - 1)
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array(w[some])], names=["slot", "weight"])

    sample = ids.join(F.broadcast(spark.createDataFrame([(r["doc_id"], r["label"]) for r in picked], "doc_id long, label int")), "doc_id").select("doc_id", "text", "label")
    sample = sample.mapInArrow(trimmed(features), kind).groupBy("doc_id", "label").agg(F.min("slots").alias("slots"))
    rows = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(trimmed(fitted), "slot int, weight double").collect()  # 2^BITS + 1 at most
    if not rows:
        return Weights(np.zeros(0, np.int32), np.zeros(0), -60.0)
    slot, weight = np.array([r["slot"] for r in rows], np.int32), np.array([r["weight"] for r in rows])
    return Weights(slot[:-1], weight[:-1], float(weight[-1]))


def toxicity(documents: DataFrame, model: Weights, limit: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of each row."""
    spark = prepare(documents.sparkSession)
    held = spark.sparkContext.broadcast(model)
    kind = "doc_id long, score double, predicted int"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = held.value.dense()
        for b in parts:
            score = held.value.score(texts_of(b.column(1)), dense)
            yield pa.record_batch([b.column(0), pa.array(score), pa.array((score >= limit).astype(np.int32))], schema=arrow(kind))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), kind)
