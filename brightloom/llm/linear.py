"""Hashed byte n-gram counts of whole texts, and logistic regressions on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, texts_of, trimmed

DIMENSIONS = 4096


def ngram_slots(data: np.ndarray, n: int) -> np.ndarray:
    """The slot of the n bytes that start at each place; the last n-1 places have none."""
    code = np.zeros(max(0, len(data) - n + 1), np.uint32)
    for i in range(n):
        code = code * np.uint32(257) + data[i : len(data) - n + 1 + i]
    return ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int32)


def ngram_features(texts: list[str], n: int = 3) -> Iterator[tuple[int, np.ndarray]]:
    """(position, square roots of the shares of each slot) of whole texts; all zeros for a text under n bytes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    for i, j in batches_of(raw):
        data = np.frombuffer(b"".join(raw[i:j]), np.uint8)
        at = 0
        slots = ngram_slots(data, n) if len(data) < 1 << 22 else None
        for k in range(i, j):
            size = len(raw[k])
            count = np.zeros(DIMENSIONS, np.int64)
            if slots is not None:
                count += np.bincount(slots[at : at + size - n + 1], minlength=DIMENSIONS) if size >= n else 0
            else:  # one long text, in steps that overlap by n-1 bytes
                for s in range(0, size, 1 << 20):
                    count += np.bincount(ngram_slots(data[s : s + (1 << 20) + n - 1], n), minlength=DIMENSIONS)
            at += size
            yield k, np.sqrt(count / max(1, count.sum())).astype(np.float32)


def among_first(key: Column, wanted: int, rows: Column | int) -> Column:
    """Whether a key's hash is so low that about four times the wanted number of rows pass: a sample's choice then starts
    from few rows, however many there are."""
    share = F.least(F.lit(1.0), F.lit(4.0 * wanted + 100) / rows)
    return F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 11) < F.lit(float(1 << 53)) * share


def collected_features(documents: DataFrame, sample: list[tuple[int, str]], features: Callable[[list[str]], Iterator[tuple[int, np.ndarray]]] = ngram_features, label: str = "label") -> tuple[list[tuple[int, str]], np.ndarray]:
    """(keys, features) of a sample (doc_id, label) of bounded size: whole texts are counted on the executors, counts come
    to the driver. Only rows that have both count. Of rows that repeat them the smallest features count, so that the choice
    is the same each time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x = [f.astype(np.float16).tobytes() for _, f in features(texts_of(b.column(1)))]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(x, pa.binary())], names=["doc_id", "label", "x"])

    ids = documents.sparkSession.createDataFrame(sample, "doc_id long, label string")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label")).where("text is not null")
    rows = texts.join(F.broadcast(ids), ["doc_id", "label"], "left_semi").select("doc_id", "text", "label").mapInArrow(trimmed(run), "doc_id long, label string, x binary").groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect()  # as many as the sample has
    rows.sort(key=lambda r: (r["doc_id"], r["label"]))
    return [(r["doc_id"], r["label"]) for r in rows], np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32).reshape(len(rows), DIMENSIONS)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) for each column of y (targets from 0 to 1), by accelerated gradient steps from zero, all in the type of x."""
    n, d = x.shape
    w = np.zeros((d + 1, y.shape[1]), x.dtype)
    v, last = w.copy(), w.copy()
    a = np.hstack([x, np.ones((n, 1), x.dtype)])
    weight, y = (weight / weight.sum(axis=0)).astype(x.dtype), y.astype(x.dtype)
    step = x.dtype.type(4.0 / float((a * a).sum(axis=1).max()))  # the curvature of a row's loss is at most a quarter of its squared length
    decay = x.dtype.type(decay)
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        w = v - step * (a.T @ (weight * (p - y)) + decay * v)
        v = w + x.dtype.type(i / (i + 3)) * (w - last)
        last = w
    return w[:-1], w[-1]
