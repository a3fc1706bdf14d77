"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a logistic regression on hashed byte trigrams tells whether the text's
language has that bit. Decoding adds up each bit's logistic loss, weighted by how accurate the bit was on the sample,
and takes the codeword with the least; a small lead over the next one flags the text as ambiguous.

The classifiers learn all values of lang, from a bounded sample (PER_LANGUAGE documents of each, SAMPLE in all, chosen by a
hash of doc_id, whole texts). Scoring covers whole texts of all rows.

Defined results: more than MOST values of lang are no languages and raise an error. null text, or text without a letter, gives `und` with score 0. Without labelled rows every prediction
is `und`. Rows that repeat get equal results; other columns are ignored. A null doc_id isn't held out and isn't learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, prepare, trimmed
from .linear import among_first, collected_features, fit_logistic, ngram_features

#: Documents of each language in the sample, documents of the sample, and the most values of lang.
PER_LANGUAGE, SAMPLE, MOST = 400, 8000, 1000
#: A lead in probability under this is ambiguous.
AMBIGUOUS = 0.2
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1. Up to 7 languages all ways to part them, else random columns of which the best draw of 20 counts."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        return np.array([[1 if i == 0 or (c >> (i - 1)) & 1 == 0 else -1 for c in range(1, 2 ** (n - 1))] for i in range(n)], np.int8)
    draw, best, far = np.random.default_rng(7), None, -1
    for _ in range(20):
        code = np.where(draw.random((n, 6 * n.bit_length())) < 0.5, 1, -1).astype(np.int8)
        code = code[:, abs(code.sum(axis=0)) < n]
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > far:
            best, far = code, apart
    return best


@dataclass
class Languages:
    names: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language's index, its probability, its lead) for rows of one margin a bit."""
        # a bit's loss has two values, so the sums over bits are two products; rows x languages is all that is held
        loss = (np.logaddexp(0, -margins) * self.trust) @ (self.code.T > 0) + (np.logaddexp(0, margins) * self.trust) @ (self.code.T < 0)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        ordered = np.sort(p, axis=1)
        return best, ordered[:, -1], ordered[:, -1] - (ordered[:, -2] if p.shape[1] > 1 else 0)


def learn(labelled: DataFrame) -> Languages:
    """From rows (doc_id, text, lang)."""
    rows = labelled.where("doc_id is not null and lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST + 1).collect()}
    if len(counts) > MOST:
        raise ValueError(f"lang has more than {MOST} values")
    names = sorted(counts)
    if not names:
        return Languages([], np.ones((0, 1), np.int8), np.zeros((0, 1)), np.zeros(1), np.ones(1))
    per = min(PER_LANGUAGE, SAMPLE // len(names))
    sizes = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, counts[n])]), F.col("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # a doc_id that repeats has the smallest of its values of lang
    picked = rows.where(among_first(F.col("doc_id"), per, sizes)).groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per).select("doc_id", "lang")
    picked = {r["doc_id"]: r["lang"] for r in picked.collect()}  # SAMPLE rows at most
    keys, x = collected_features(labelled, list(picked.items()), label="lang")
    at = np.array([names.index(lang) for _, lang in keys])
    code = codewords(len(names))
    y = (code[at] > 0).astype(np.float64)
    per_class = 1 / np.bincount(at, minlength=len(names))[at]
    w, b = fit_logistic(x, y, np.repeat(per_class[:, None], y.shape[1], axis=1))
    right = ((x @ w + b > 0) == (y > 0)).mean(axis=0)
    trust = np.clip(2 * right - 1, 0.01, 1)
    return Languages(names, code, w * 4, b * 4, trust / trust.sum() * len(trust))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(documents: DataFrame, model: Languages) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of each row."""
    spark = prepare(documents.sparkSession)
    held = spark.sparkContext.broadcast(model)
    kind = "doc_id long, lang_pred string, score double, ambiguous boolean"
    out = arrow(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        w = m.weights.astype(np.float32)
        for b in parts:
            texts = b.column(1).to_pylist()
            known = [t is not None and bool(m.names) and has_letter(t) for t in texts]
            margins = np.zeros((len(texts), len(m.bias)))
            if m.names:
                for k, x in ngram_features([t if ok else "" for t, ok in zip(texts, known, strict=True)]):
                    margins[k] = x @ w + m.bias
                best, p, lead = m.decode(margins)
            else:
                best, p, lead = (np.zeros(len(texts), int),) * 3
            yield pa.record_batch([b.column(0), pa.array([m.names[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)]), pa.array([float(v) if ok else 0.0 for v, ok in zip(p, known, strict=True)]), pa.array([not ok or v < AMBIGUOUS for v, ok in zip(lead.tolist(), known, strict=True)], pa.bool_())], schema=out)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), kind)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
