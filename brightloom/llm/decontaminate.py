"""Benchmark decontamination by a BM25 index of the test items with block-max WAND.

Every document is cut into pieces of as many words as the longest item has; a passage is two neighbouring pieces, so
each span as long as an item lies whole in some passage. Every passage is a query on the inverted index of the items.
Impacts are BM25 impacts divided by the item's score for itself, so one threshold serves all items. Items lie in blocks,
and a term's list has an entry for each block that has the term, with its largest impact there.

A passage has a cursor on the list of each of its terms. In each step its cursors are ordered by their blocks; the pivot is the first
one at which the terms' largest impacts add up to the threshold. No block before the pivot's can hold a result, so
the cursors behind it skip to that block. If the largest impacts of the cursors that are then at the pivot's block reach the
threshold, its items are scored; those cursors move on. A passage without a pivot is done. Steps are taken for many passages at once.

Whatever scores at least the threshold is verified: enough of the question's and of the answer's word n-grams must be in
the passage. The last line of an item is the answer, or its last sentence if it has one line, and a quarter of it at least.

The items are indexed in shards of at most SHARD_WORDS words. Where one holds them all, documents are searched where they lie.
Else each shard goes over all documents in a job of its own, which writes what it found by the text's SHA-256, so that one broadcast is held
at a time. Document frequencies, mean and largest lengths are those of all items, so scores don't depend on the shards.

Defined results: null counts as empty. Items without words match nothing. A text shorter than an item is one passage.
Rows that repeat get equal results, a null doc_id too; other columns are ignored. Without items nothing is contaminated.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, discard, in_bitmap, key_bitmap, mix, prepare, stored, texts_of, trimmed, unused
from .words import NON_WORD, word_hashes

#: Least share of an item's score for itself, and of the n-grams of its question and of its answer.
SCORE, OVERLAP, GRAM = 0.5, 0.7, 3
#: Items of a block of the index; words of the items that are broadcast at a time; cursors that a search holds at a time; BM25's parameters.
BLOCK, SHARD_WORDS, CURSORS, K1, B = 8, 1 << 22, 1 << 19, 1.2, 0.75


def _grams(h: np.ndarray) -> np.ndarray:
    n = min(GRAM, len(h))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0xA0761D6478BD642F) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def answer_start(text: str, n: int) -> int:
    """The word at which the answer starts, of n: at the last line, or at the last sentence, and so that it has a quarter of the words and GRAM at least."""
    lines = [x for x in text.strip().split("\n") if x.strip()]
    answer = lines[-1] if len(lines) > 1 else re.split(r"(?<=[.?!])\s+", text.strip())[-1]
    return max(0, min(n - len(word_hashes([answer.lower()], NON_WORD)[0]), n - GRAM, n - n // 4))


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, once each; runs that are sorted already cost little."""
    x = np.sort(x, kind="stable")
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


@dataclass
class Statistics:
    """Of all items with words: their number, their mean and largest lengths, and for a shard's terms the number of items that have them."""

    items: int
    mean: float
    longest: int
    frequency: dict[int, int]


def item_words(rows: list[tuple[int, str]]) -> list[np.ndarray]:
    """The hashes of each item's words."""
    h, n = word_hashes([t.lower() for _, t in rows], NON_WORD)
    return np.split(h, np.cumsum(n)[:-1]) if rows else []


def statistics_of(words: list[np.ndarray]) -> Statistics:
    sizes = [len(w) for w in words if len(w)]
    terms, counts = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True) if sizes else (np.zeros(0, np.uint64), np.zeros(0, int))
    return Statistics(len(sizes), sum(sizes) / max(1, len(sizes)), max(sizes, default=0), dict(zip(terms.tolist(), counts.tolist(), strict=True)))


@dataclass
class Index:
    ids: np.ndarray
    terms: np.ndarray  # sorted hashes of the items' words
    first: np.ndarray  # of a term's entries, one for each block that has it
    block: np.ndarray  # an entry's block
    entry: np.ndarray  # its term and block in one number, ascending
    most: np.ndarray  # its largest impact
    posting: np.ndarray  # its first posting
    items: np.ndarray
    impacts: np.ndarray
    limit: np.ndarray  # a term's largest impact
    blocks: int
    question: list[np.ndarray]
    answer: list[np.ndarray]
    longest: int
    scored: int = 0  # (passage, block) pairs whose items were scored

    @classmethod
    def build(cls, rows: list[tuple[int, str]], of: Statistics | None = None) -> Index:
        own = item_words(rows)
        of = of or statistics_of(own)
        # the longer items first, so that items of a block have impacts alike
        order = sorted((i for i in range(len(rows)) if len(own[i])), key=lambda i: (-len(own[i]), rows[i][0], rows[i][1]))
        held: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, i in enumerate(order):
            for t, c in zip(*(x.tolist() for x in np.unique(own[i], return_counts=True)), strict=True):
                held[t].append((at, c))
        names = sorted(held)
        sizes = [len(held[t]) for t in names]
        items = np.array([a for t in names for a, _ in held[t]], np.int64)
        count = np.array([c for t in names for _, c in held[t]], np.float64)
        idf = np.repeat([math.log(1 + (of.items - of.frequency[t] + 0.5) / (of.frequency[t] + 0.5)) for t in names], sizes)
        size = np.array([len(own[i]) for i in order], np.float64)
        impact = idf * count * (K1 + 1) / (count + K1 * (1 - B + B * size[items] / max(1.0, of.mean))) if len(items) else count
        impact = impact / np.bincount(items, impact, minlength=len(order))[items] if len(items) else impact
        term = np.repeat(np.arange(len(names)), sizes)
        blocks = -(-len(order) // BLOCK)
        starts = np.flatnonzero(np.diff(term * blocks + items // BLOCK, prepend=-1))
        most = np.maximum.reduceat(impact, starts) * 1.00001 if len(items) else impact
        first = np.searchsorted(term[starts], np.arange(len(names) + 1))
        limit = np.maximum.reduceat(most, first[:-1]) if len(items) else impact
        cut = [answer_start(rows[i][1], len(own[i])) for i in order]
        grams = [[_grams(own[i][:c] if c >= GRAM else own[i]) for i, c in zip(order, cut, strict=True)], [_grams(own[i][c:]) for i, c in zip(order, cut, strict=True)]]
        return cls(np.array([rows[i][0] for i in order], np.int64), np.array(names, np.uint64), first, items[starts] // BLOCK, term[starts] * blocks + items[starts] // BLOCK, most, np.append(starts, len(items)), items, impact, limit, blocks, *grams, of.longest)

    def search(self, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(document's position, item's position, score) of each verified pair, from the words of many documents."""
        if not len(self.ids) or not len(words):
            return
        span, terms = self.longest, len(self.terms)
        at = np.searchsorted(self.terms, words)
        at[at == terms] = 0
        known = self.terms[at] == words
        starts = np.cumsum(counts) - counts
        per_doc = np.maximum(1, -(-counts // span))
        piece_at = np.cumsum(per_doc) - per_doc
        doc = np.repeat(np.arange(len(counts)), counts)[known]
        piece = piece_at[doc] + (np.flatnonzero(known) - starts[doc]) // span
        pairs = _distinct(piece * terms + at[known])
        piece_doc = np.repeat(np.arange(len(counts)), per_doc)
        opens, whole = np.zeros(len(piece_doc) + 1, bool), np.ones(len(piece_doc), bool)
        opens[piece_at] = True
        whole[piece_at + per_doc - 1] = per_doc == 1  # a document's last piece is in the passage before it
        at_piece = np.searchsorted(pairs, np.arange(len(piece_doc) + 2) * terms)
        best: dict[tuple[int, int], float] = {}
        low = 0
        while low < len(piece_doc):  # a bounded number of cursors at a time
            high = max(low + 1, int(np.searchsorted(at_piece, at_piece[low] + CURSORS // 2, side="right")) - 2)
            high = min(high, len(piece_doc))
            one, two = pairs[at_piece[low] : at_piece[high]], pairs[at_piece[low + 1] : at_piece[high + 1]]
            two = two[~opens[two // terms]] - terms  # the second pieces of passages
            here = _distinct(np.concatenate([one, two]))
            here = here[whole[here // terms]]
            for k, i, score in self._wand(here // terms, here % terms):
                d = int(piece_doc[k])
                if best.get((d, i), 0) >= score:
                    continue
                lo = int(starts[d]) + (k - int(piece_at[d])) * span
                grams = _grams(words[lo : min(lo + 2 * span, int(starts[d] + counts[d]))])
                if all(len(part) and np.isin(part, grams).mean() >= OVERLAP for part in (self.question[i], self.answer[i])):
                    best[d, i] = score
            low = high
        yield from ((d, i, s) for (d, i), s in best.items())

    def _wand(self, passage: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, item's position, score) of all that score at least SCORE, from distinct pairs in order."""
        if not len(passage):
            return
        shift = int(passage[0])
        passage = (passage - shift).astype(np.int32)
        limit, cursor, end, list_at = self.limit[term], self.first[term], self.first[term + 1], term * self.blocks
        keep = np.ones(len(passage), bool)
        start = np.flatnonzero(np.diff(passage, prepend=-1))
        while True:
            # a pivot needs terms whose largest impacts reach the threshold; passages without one are done
            alive = np.add.reduceat(np.where(keep, limit, 0.0), start) >= SCORE
            keep &= np.repeat(alive, np.diff(np.append(start, len(passage))))
            passage, limit, cursor, end, list_at = passage[keep], limit[keep], cursor[keep], end[keep], list_at[keep]
            if not len(passage):
                return
            start = np.flatnonzero(np.diff(passage, prepend=-1))
            size = np.diff(np.append(start, len(passage)))
            block = self.block[cursor]
            order = np.argsort(passage * np.int64(self.blocks) + block)  # passages stay where they are
            total = np.cumsum(limit[order])
            total -= np.repeat(total[start] - limit[order[start]], size)
            before = np.add.reduceat(total < SCORE * 0.999999, start, dtype=np.int64)
            goal = np.repeat(block[order[start + np.minimum(before, size - 1)]], size)
            behind = np.flatnonzero(block < goal)
            cursor[behind] = np.searchsorted(self.entry, list_at[behind] + goal[behind])
            there = (cursor < end) & (self.block[np.minimum(cursor, len(self.block) - 1)] == goal)
            at = np.flatnonzero(there)
            most = np.zeros(len(passage))
            most[at] = self.most[cursor[at]]
            good = np.repeat(np.add.reduceat(most, start) >= SCORE, size) & there
            if good.any():
                yield from self._scored(passage[good], cursor[good], goal[good], shift)
            cursor[at] += 1
            keep = cursor < end

    def _scored(self, passage: np.ndarray, cursor: np.ndarray, block: np.ndarray, shift: int) -> Iterator[tuple[int, int, float]]:
        """Scores the items of one block for each of the passages, from the entries that their cursors are at."""
        who, slot = np.unique(passage, return_inverse=True)
        self.scored += len(who)
        n = self.posting[cursor + 1] - self.posting[cursor]
        post = np.repeat(self.posting[cursor] - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = np.bincount(np.repeat(slot, n) * BLOCK + self.items[post] % BLOCK, self.impacts[post], minlength=len(who) * BLOCK)
        at = np.zeros(len(who), np.int64)
        at[slot] = block
        for x in np.flatnonzero(score >= SCORE).tolist():
            yield int(who[x // BLOCK]) + shift, int(at[x // BLOCK]) * BLOCK + x % BLOCK, float(score[x])


def _statistics(items: DataFrame) -> DataFrame:
    """(term, n, size, longest, shards), written: for each term the items that have it, and the shards that do; for no term the items, their words and the longest, from (shard, item_id, text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            words = item_words(list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)))
            for shard, w in zip(b.column(0).to_pylist(), words, strict=True):
                if len(w):
                    t = np.unique(w).view(np.int64)
                    n = len(t) + 1
                    yield pa.record_batch([pa.array([shard] * n, pa.int32()), pa.array([None, *t.tolist()], pa.int64()), pa.array([len(w)] + [0] * (n - 1), pa.int64())], names=["shard", "term", "size"])

    rows = items.select("shard", "item_id", "text").mapInArrow(trimmed(run), "shard int, term long, size long")
    return stored(rows.groupBy("term").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("size").alias("longest"), F.collect_set("shard").alias("shards")), "items")


def _indexes(documents: DataFrame, benchmark: DataFrame) -> tuple[int, Iterator[Broadcast[Index]]]:
    """The number of shards, and a broadcast index for each; about 2 x SHARD_WORDS characters."""
    spark = prepare(documents.sparkSession)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-int(size) // (2 * SHARD_WORDS)))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))

    def built() -> Iterator[Broadcast[Index]]:
        known = _statistics(items)
        try:
            of = known.where("term is null").first()
            for shard in range(shards):
                rows = items.where(F.col("shard") == shard).orderBy("item_id", "text").collect()
                frequency = {r["term"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in known.where("term is not null").where(F.array_contains("shards", shard)).select("term", "n").collect()}  # terms of the shard
                stats = Statistics(of["n"], of["size"] / of["n"], of["longest"], frequency) if of else Statistics(0, 0.0, 0, {})
                yield spark.sparkContext.broadcast(Index.build([(r["item_id"], r["text"]) for r in rows], stats))
        finally:
            discard(known)

    return shards, built()


def _by_text(documents: DataFrame, indexes: Iterator[Broadcast[Index]]) -> DataFrame:
    """(sha, item_ids, best_score) of each text that has an item of any shard, written."""
    kind = "sha string, item_ids array<long>, best_score double"
    out = arrow(kind)
    texts = documents.select(_sha(), F.col("text").cast("string").alias("text"))
    parts = []
    for index in indexes:

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, best = _matches(index.value, texts_of(b.column(1)))
                some = pa.array([bool(x) for x in ids], pa.bool_())
                yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())], schema=out).filter(some)

        parts.append(stored(texts.mapInArrow(trimmed(run), kind), "found"))
        index.destroy()
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    found = every.groupBy("sha").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"), F.max("best_score").alias("best_score"))
    found = stored(found, "contaminated")
    discard(*parts)
    return found


def _sha() -> Column:
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("sha")


def _matches(index: Index, texts: list[str]) -> tuple[list[list[int]], list[float]]:
    """For each text the items that it has, and the best score."""
    ids: list[set[int]] = [set() for _ in texts]
    best = [0.0] * len(texts)
    words, counts = word_hashes([t.lower() for t in texts], NON_WORD)
    for d, i, s in index.search(words, counts):
        ids[d].add(int(index.ids[i]))
        best[d] = max(best[d], s)
    return list(map(sorted, ids)), best


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, best_score) of each row."""
    shards, indexes = _indexes(documents, benchmark)
    if shards > 1:
        found = _by_text(documents, indexes)
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _sha()).join(found, "sha", "left")
        rows = rows.select("doc_id", F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"))
    else:
        rows = _searched(documents, next(indexes))
    return rows.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "best_score")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a verified item, with all their columns; of one shard searched where they lie, so nothing is joined."""
    shards, indexes = _indexes(documents, benchmark)
    if shards > 1:
        found = _by_text(documents, indexes).select(F.struct("sha").alias(told := unused(documents, "found")))
        maybe = in_bitmap(documents.sparkSession, key_bitmap(found.select(F.xxhash64(f"{told}.sha").alias("key")), "key"), F.xxhash64(_sha()))
        return documents.where(~maybe).unionByName(documents.where(maybe).join(found, _sha() == F.col(f"{told}.sha"), "left_anti"))
    at, index = documents.columns.index("text"), next(indexes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield b.filter(pa.array([not x for x in _matches(index.value, texts_of(b.column(at)))[0]], pa.bool_()))

    return documents.mapInArrow(trimmed(run), documents.schema)


def _searched(documents: DataFrame, index: Broadcast[Index]) -> DataFrame:
    """(doc_id, item_ids, best_score) of each row."""
    kind = "doc_id long, item_ids array<long>, best_score double"
    out = arrow(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids, best = _matches(index.value, texts_of(b.column(1)))
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())], schema=out)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), kind)
