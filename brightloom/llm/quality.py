"""Quality classification from weak labels.

Overlapping heuristics vote for or against a document or abstain. Expectation-maximisation over the vote patterns of all
documents estimates how each heuristic votes on good documents and on each kind of bad ones, hence its accuracy, and gives
each pattern a posterior. (With one kind of bad documents only, it gives up the heuristics that see few of them.) Posterior
labels of a bounded sample (SAMPLE documents of either kind, chosen by a hash of doc_id, whole texts) train a logistic
regression on hashed features (byte trigrams and the votes), which scores whole texts of all rows.

There are at most 3 to the power of the number of heuristics patterns, so their counts fit the driver at any size.

Defined results: null counts as empty. A text without words has score 0 and is rejected. If all weak labels agree, there is
nothing to tell apart and the score is the posterior's rounded label. Rows that repeat get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, prepare, scratch, stored, texts_of, trimmed
from .linear import DIMENSIONS, among_first, collected_features, fit_logistic, ngram_features
from .words import word_hashes

#: Documents of either weak label in the sample.
SAMPLE = 1000
#: A document is rejected if the score is under this.
REJECT = 0.35

HEURISTICS = ("capitals", "marks", "shouting", "repeated_words", "common_word", "word_length", "digits", "bars")
GOOD, BAD, ABSTAIN = 1, 0, 2
PLACES = 3 ** np.arange(len(HEURISTICS))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?/@|_=")
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])


def _vote(value: float, good: float, bad: float) -> int:
    """Good up to one limit, bad from another, between them no vote."""
    return GOOD if value <= good else BAD if value >= bad else ABSTAIN


def votes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of votes for each text, number of its words)."""
    hashes, counts = word_hashes(texts)
    out = np.full((len(texts), len(HEURISTICS)), ABSTAIN, np.int8)
    at = 0
    for i, (t, n) in enumerate(zip(texts, counts.tolist(), strict=True)):
        if n:
            raw = t.encode("utf-8", "surrogatepass")
            h = hashes[at : at + n]
            size = len(raw)
            without = lambda kinds: size - len(raw.translate(None, kinds))  # noqa: B023, E731
            letters = without(_LETTERS)
            order = np.sort(h)
            edges = np.flatnonzero(np.append(True, order[1:] != order[:-1]))
            most = int(np.diff(np.append(edges, n)).max())
            out[i] = (
                _vote(without(_UPPER) / max(1, letters), 0.2, 0.5) if letters >= 40 else ABSTAIN,
                _vote(without(_MARKS) / n, 0.2, 0.6),
                _vote(raw.count(b"!!") / n, 0.05, 0.3),
                _vote(float((h[1:] == h[:-1]).mean()), 0.1, 0.4) if n >= 8 else ABSTAIN,
                _vote(most / n, 0.25, 0.5) if n >= 8 else ABSTAIN,
                GOOD if 2 <= len(t) / n - 1 <= 14 else BAD if len(t) / n > 40 else ABSTAIN,
                _vote(without(_DIGITS) / size, 0.1, 0.4) if n >= 8 else ABSTAIN,
                _vote(raw.count(b" | ") / n, 0.05, 0.2),
            )
            at += n
    return out, counts


def vote_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, words, pattern): votes as digits to the base of 3."""
    kind = "doc_id long, words long, pattern int"
    out = arrow(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            v, n = votes(texts_of(b.column(1)))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array((v.astype(np.int64) @ PLACES).astype(np.int32))], schema=out)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), kind)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, how often each heuristic gives each vote in each class, share of each class).

    Bad documents are of several kinds, and most heuristics see one kind only, so the classes are one kind for each
    heuristic and, last, good. It starts from the kind of the first vote against. Tables are smoothed by a count for
    the vote that fits, so that good stays good. Abstaining says nothing of the class.
    """
    m = len(HEURISTICS)
    digits = (patterns[:, None] // 3 ** np.arange(m)) % 3
    against = digits == BAD
    first = np.where(against.any(axis=1), against.argmax(axis=1), m)
    post = np.full((len(patterns), m + 1), 0.1 / m)
    post[np.arange(len(patterns)), first] = 0.9
    post[~(digits != ABSTAIN).any(axis=1)] = 1 / (m + 1)
    table, share = np.ones((m + 1, m, 3)), np.ones(m + 1)
    for _ in range(rounds):
        weight = post * counts[:, None]
        for v in (BAD, GOOD):
            table[:, :, v] = weight.T @ (digits == v) + 0.1
        table[m, :, GOOD] += 1
        table[np.arange(m), np.arange(m), BAD] += 1
        table[:, :, :ABSTAIN] /= table[:, :, :ABSTAIN].sum(axis=2, keepdims=True)
        share = (weight.sum(axis=0) + 1) / (counts.sum() + m + 1)
        logs = np.log(share) + sum(np.log(table[:, j, :])[:, digits[:, j]].T for j in range(m))
        after = np.exp(logs - logs.max(axis=1, keepdims=True))
        after /= after.sum(axis=1, keepdims=True)
        moved, post = np.abs(after - post).max(initial=0), after
        if moved < 1e-9:
            break
    return post[:, m], table, share


def accuracies(patterns: np.ndarray, counts: np.ndarray, post: np.ndarray) -> np.ndarray:
    """A row for each heuristic, of the documents that it voted on, by the posterior: the share of right votes, of votes
    against among bad ones, of votes for among good ones; nan where there are none."""
    out = np.full((len(HEURISTICS), 3), np.nan)
    for j in range(len(HEURISTICS)):
        vote = (patterns // 3**j) % 3
        good, bad = ([float((counts * p)[vote == v].sum()) for v in (GOOD, BAD)] for p in (post, 1 - post))
        for i, (right, of) in enumerate(((good[0] + bad[1], sum(good) + sum(bad)), (bad[1], sum(bad)), (good[0], sum(good)))):
            if of > 0:
                out[j, i] = right / of
    return out


def features(texts: list[str], found: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Hashed features of whole texts: byte trigrams, and each heuristic with its vote."""
    found = votes(texts)[0] if found is None else found
    for k, x in ngram_features(texts):
        for j, v in enumerate(found[k].tolist()):
            x[(2654435761 * (3 * j + v + 1) & 0xFFFFFFFF) >> 20] += 0.5
        yield k, x


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    linear: bool
    posterior: dict[int, float]
    accuracies: np.ndarray

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, posterior, number of words) of each text."""
        v, n = votes(texts)
        post = np.array([self.posterior.get(p, 0.5) if k else 0.0 for p, k in zip((v.astype(np.int64) @ PLACES).tolist(), n.tolist(), strict=True)])
        score = np.where(n > 0, np.round(post), 0.0)
        if self.linear:
            for k, x in features(texts, v):
                if n[k]:
                    score[k] = 1 / (1 + np.exp(-np.clip(float(x @ self.weights) + self.bias, -60, 60)))
        return score, post, n


def train(documents: DataFrame) -> Model:
    """Votes of all documents, posteriors of their patterns, and the scorer from a bounded sample."""
    prepare(documents.sparkSession)
    with scratch():
        return _trained(documents, stored(vote_rows(documents), "votes").where("words > 0"))


def _trained(documents: DataFrame, rows: DataFrame) -> Model:
    found = rows.groupBy("pattern").count().orderBy("pattern").collect()  # 3^8 rows at most
    patterns, counts = np.array([r["pattern"] for r in found], np.int64), np.array([r["count"] for r in found], np.float64)
    post = estimate(patterns, counts)[0] if found else np.zeros(0)
    posterior, right = dict(zip(patterns.tolist(), post.tolist(), strict=True)), accuracies(patterns, counts, post)
    picked: set[tuple[int, int]] = set()
    for label in (False, True):
        chosen = [p for p, x in posterior.items() if (x >= 0.5) == label]
        if chosen:
            size = int(sum(n for p, n in zip(patterns.tolist(), counts.tolist(), strict=True) if p in set(chosen)))
            some = rows.where(F.col("pattern").isin(chosen) & F.col("doc_id").isNotNull() & among_first(F.col("doc_id"), SAMPLE, size)).select("doc_id", "pattern").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "pattern").limit(SAMPLE)
            picked |= {(r["doc_id"], r["pattern"]) for r in some.collect()}  # SAMPLE rows at most
    if len({posterior[p] >= 0.5 for _, p in picked}) < 2:
        return Model(np.zeros(DIMENSIONS, np.float32), 0.0, False, posterior, right)
    sampled = documents.sparkSession.createDataFrame(sorted({(d,) for d, _ in picked}), "doc_id long")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sampled), "doc_id", "left_semi")  # SAMPLE rows of either label

    @F.arrow_udf("string")
    def pattern_of(texts: pa.Array) -> pa.Array:
        return pa.array(map(str, (votes(texts_of(texts))[0].astype(np.int64) @ PLACES).tolist()))

    # an id's rows count only where they have a pattern that was picked, so text and label belong together
    keys, x = collected_features(texts.withColumn("pattern", pattern_of("text")), sorted((d, str(p)) for d, p in picked), features, label="pattern")
    y = np.array([[posterior[int(p)]] for _, p in keys])
    weight = np.where(y >= 0.5, 1 / max(1, (y >= 0.5).sum()), 1 / max(1, (y < 0.5).sum()))
    w, b = fit_logistic(x, y, weight)
    return Model(4 * w[:, 0].astype(np.float32), 4 * float(b[0]), True, posterior, right)


def labeller_accuracies(documents: DataFrame) -> DataFrame:
    """(heuristic, accuracy, sensitivity, specificity) as estimated without labels; null where it didn't vote on such documents."""
    model = train(documents)
    rows = [(h, *(None if np.isnan(x) else float(x) for x in a)) for h, a in zip(HEURISTICS, model.accuracies, strict=True)]
    return documents.sparkSession.createDataFrame(rows, "heuristic string, accuracy double, sensitivity double, specificity double")


def quality_scores(documents: DataFrame) -> DataFrame:
    """(doc_id, posterior, score, kept) of each row."""
    held = documents.sparkSession.sparkContext.broadcast(train(documents))
    kind = "doc_id long, posterior double, score double, kept boolean"
    out = arrow(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            score, post, _ = held.value.score(texts_of(b.column(1)))
            yield pa.record_batch([b.column(0), pa.array(post), pa.array(score), pa.array(score >= REJECT)], schema=out)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), kind)


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows that aren't rejected, with all their columns; scored where they lie, so nothing is joined."""
    held = documents.sparkSession.sparkContext.broadcast(train(documents))
    at = documents.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield b.filter(pa.array(held.value.score(texts_of(b.column(at)))[0] >= REJECT))

    return documents.mapInArrow(trimmed(run), documents.schema)
