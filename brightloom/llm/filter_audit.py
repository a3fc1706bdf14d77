"""How quality filters interact: what each removes first, again, or alone, in every order of applying them.

Texts are scanned in Arrow's own buffers: a table gives each byte's classes, prefix sums of the classes at the documents'
ends give words, capitals, symbols and code points. Words are hashed from one prefix sum over the buffer; sorted hashes of a
document give its distinct words, and words with equal hashes are compared byte by byte, so a collision costs time only. The
five tests of a document are five bits. Copies are found by a digest of the text: the smallest doc_id of each digest is joined
back by digest and doc_id, so a large group of copies is spread over its ids. Counts of bits for each part then meet a fixed
table of all orders (FILTERS! x FILTERS x 2^FILTERS rows).

Filters: A few words, B few distinct words, C many capitals, D symbols, E a copy of a smaller doc_id's text.

Defined results: null text is empty and fails A only (and E, if a smaller doc_id is empty too); a null part is the empty
text. A null doc_id is no copy and makes none. Of rows that repeat the smallest doc_id of a text none fails E. An id with
several labels is good, or toxic, if any of them says so. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, mix, prepare, scratch, stored, trimmed
from .words import SPACE

FILTERS = "ABCDE"
#: Limits: A words; B percent of words that are distinct; C percent of code points that are capitals; D symbols.
WORDS, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
#: Bytes that are scanned at a time.
STEP = 1 << 20
_CAPITAL, _SYMBOL, _POINT = (np.array([c in kinds for c in range(256)]) for kinds in (range(65, 91), SYMBOLS, [*range(0x80), *range(0xC0, 256)]))
_BASE = 0x9FB21C651E98DF25
_powers = [np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse."""
    if len(_powers[0]) < n:
        steps = [np.full(1 << (n - 1).bit_length(), b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        _powers[:] = [np.cumprod(s, dtype=np.uint64) for s in steps]
    return _powers[0], _powers[1]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word of a byte array that ends with a separator or a word's end."""
    gap = np.empty(len(data) + 2, np.int8)
    gap[0] = gap[-1] = 1
    gap[1:-1] = SPACE[data]
    edge = np.diff(gap)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def repeats(data: np.ndarray, of: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each word repeats an earlier one of its document (of). Of equal keys the bytes are compared."""
    own = mix(key ^ of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    same = np.flatnonzero(own[order[1:]] == own[order[:-1]])
    one, two = order[same], order[same + 1]
    equal = (of[one] == of[two]) & (end[one] - start[one] == end[two] - start[two])
    length = np.where(equal, end[one] - start[one], 0)
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    differ = data[np.repeat(start[one], length) + step] != data[np.repeat(start[two], length) + step]
    equal[np.repeat(np.arange(len(length)), length)[differ]] = False
    out = np.zeros(len(of), bool)
    out[two[equal]] = True
    if not equal.all():  # different words with one hash: those documents' words are told apart as they are
        for d in np.unique(of[np.concatenate([one[~equal], two[~equal]])]):
            seen: set[bytes] = set()
            for k in np.flatnonzero(of == d).tolist():
                word = data[start[k] : end[k]].tobytes()
                out[k] = word in seen
                seen.add(word)
    return out


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row (words, distinct words, capitals, symbols, code points) for each text of an Arrow buffer."""
    n = len(offsets) - 1
    out = np.zeros((n, 5), np.int64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, side="right")) - 1)
        piece, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(piece) > STEP:
            out[i] = _long(piece)
        elif len(piece):
            for k, kind in ((2, _CAPITAL), (3, _SYMBOL), (4, _POINT)):
                total = np.zeros(len(piece) + 1, np.int64)
                np.cumsum(kind[piece], out=total[1:])
                out[i:j, k] = total[cut[1:]] - total[cut[:-1]]
            # texts lie side by side: one that ends in a word mustn't run into the next
            apart = np.full(len(piece) + j - i, 0x20, np.uint8)
            apart[np.arange(len(piece)) + np.repeat(np.arange(j - i), np.diff(cut))] = piece
            start, end = word_spans(apart)
            of = np.searchsorted(cut[1:] + np.arange(j - i), start, side="right")
            again = repeats(apart, of, span_hashes(apart, start, end), start, end)
            out[i:j, 0] = np.bincount(of, minlength=j - i)
            out[i:j, 1] = out[i:j, 0] - np.bincount(of[again], minlength=j - i)
        i = j
    return out


def _long(data: np.ndarray) -> np.ndarray:
    """The counts of one long text, in steps that end between words; words longer than a step are hashed by themselves."""
    found, at, total = [], 0, np.zeros(5, np.int64)
    while at < len(data):
        piece = data[at : at + STEP]
        gaps = np.flatnonzero(SPACE[piece])
        stop = at + STEP if len(gaps) else at
        if at + STEP >= len(data):
            stop = len(data)
        elif len(gaps):
            stop = at + int(gaps[-1]) + 1
        if stop > at:
            start, end = word_spans(data[at:stop])
            key = span_hashes(data[at:stop], start, end)
        else:
            stop = at + STEP
            while stop < len(data) and not len(gaps := np.flatnonzero(SPACE[data[stop : stop + STEP]])):
                stop += STEP
            stop = min(len(data), stop + (int(gaps[0]) if len(gaps) else 0))
            start, end = np.array([0]), np.array([stop - at])
            key = np.frombuffer(hashlib.blake2b(data[at:stop], digest_size=8).digest(), np.uint64)
        total[0] += len(start)
        first = ~repeats(data, np.zeros(len(start), np.int64), key, start + at, end + at)
        found.append((key[first], start[first] + at, end[first] + at))
        at = stop
    key, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    total[1] = len(start) - repeats(data, np.zeros(len(start), np.int64), key, start, end).sum()
    for s in range(0, len(data), STEP):
        total[2:] += [int(kind[data[s : s + STEP]].sum()) for kind in (_CAPITAL, _SYMBOL, _POINT)]
    return total


def failures(found: np.ndarray) -> np.ndarray:
    """Bits 0 to 3 for A to D."""
    words, distinct, capitals, symbols, points = found.T
    tests = (words < WORDS, 100 * distinct < DISTINCT * words, 100 * capitals > CAPITALS * points, symbols > 0)
    return sum(t.astype(np.int32) << k for k, t in enumerate(tests))


def scanned(documents: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, mask, digest): the bits of A to D of each row, and its text's SHA-256."""
    prepare(documents.sparkSession)
    kind = "doc_id long, part string, mask int, digest binary"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = b.column(2).fill_null("").cast(pa.large_binary())
            _, offsets, data = texts.buffers()
            offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(data or b"", np.uint8)
            digests = [hashlib.sha256(raw[i:j]).digest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(failures(counts(raw, offsets)), pa.int32()), pa.array(digests, pa.binary())], schema=arrow(kind))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), kind)


def masks(documents: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, mask) of each row, E included. Stored."""
    with scratch() as keep:
        rows = stored(scanned(documents, part), "scanned")
        first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
        return keep(stored(rows.join(first.hint("merge"), ["digest", "doc_id"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask")), "masks"))


def effects() -> list[tuple[str, int, int, int, int, int, int, int]]:
    """(order, step, mask, kept, removed, redundant, unique, shapley) for each order, step and mask."""
    out = []
    for order in permutations(FILTERS):
        for step, f in enumerate(order):
            earlier = sum(1 << FILTERS.index(x) for x in order[:step])
            own = 1 << FILTERS.index(f)
            for mask in range(1 << len(FILTERS)):
                before, fails = mask & earlier != 0, mask & own != 0
                # of the orders, each of a mask's failing filters comes first in as many
                share = math.factorial(len(FILTERS)) // mask.bit_count() if fails else 0
                out.append(("".join(order), step + 1, mask, int(not before and not fails), int(not before and fails), int(before and fails), int(mask == own), share))
    return out


def audit(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    spark = prepare(documents.sparkSession)
    found = masks(documents, part)
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic_"))))
    sums = found.join(said.hint("merge"), "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic_"), F.lit(0)).alias("bad"))
    fixed = spark.createDataFrame(effects(), "filter_order string, step int, mask int, k int, r int, again int, own int, share int")
    counted = {"kept": ("n", "k"), "removed": ("n", "r"), "redundant": ("n", "again"), "unique_fails": ("n", "own"), "good_lost": ("good", "r"), "toxic_lost": ("bad", "r"), "shapley": ("n", "share")}
    return sums.join(F.broadcast(fixed), "mask").groupBy("part", "filter_order", "step").agg(*(F.sum(F.col(a) * F.col(b)).alias(c) for c, (a, b) in counted.items()))
