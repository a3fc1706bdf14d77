"""Exact self-join of documents on the Jaccard similarity of their word shingles, by a token-group matrix.

1. One pass makes each document's set, a fingerprint of the set and a frequency sketch of all shingles. Documents with
   equal sets become one representative, so copies are never paired.
2. Representatives are partitioned into groups of similar sets (size band and minimum hash), large groups are split.
   The matrix holds for each group the union of its members' probing tokens: the rarest that any partner must share.
3. A document probes the matrix with its own rarest tokens. Groups whose sizes can't match, or that share too few of
   them, are left out.
4. For each (document, group) that remains, the overlap with the union of the group's whole sets bounds the similarity
   to every member. Only groups over the bound are opened, and members are compared exactly.
5. Links become component ids.

Frequency only orders tokens, and tells those that many documents may have: these meet in a join of their own, of written tables,
which can split a token. Any order gives the same links, so the sketch's errors can't lose one.

Defined results: null counts as empty. A text without words has an empty set and links with nothing. Rows that repeat
are documents with equal sets. If a doc_id repeats with other words, the row whose set has the smallest fingerprint stands
for it, the others link with nothing and take its component. A null doc_id stays in the result, alone in its component
(null). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import anti, arrow, components, discard, mix, prepare, scratch, semi, stored, texts_of, trimmed
from .words import shingle_sets

#: Cells of the frequency sketch, the blocks that it is summed in.
CELLS, BLOCKS = 1 << 21, 64
#: Documents from which on a token is taken for a frequent one.
FREQUENT = 1 << 16
#: Members of a group, their tokens, and queries that one task compares with a group at a time.
GROUP_ROWS, GROUP_TOKENS, QUERY_ROWS = 256, 1 << 20, 512


def least_overlap(n: int, num: int, den: int) -> int:
    """Tokens that a set of n tokens must share with any partner: the threshold is num/den."""
    return -(-n * num // den)


def least_shared(n: Column, low: Column, high: Column, num: int, den: int) -> Column:
    """Probing tokens that a set of n tokens must share with any partner of low to high tokens.

    Of two sets, take the one whose probing tokens end first in the order: common tokens are among the probing tokens of
    both, or among the rest of that one. So the shared ones are at least the overlap needed less that rest. Up to n the
    need grows with the partner's size, beyond n it falls on the whole, but not in every step, as both terms are rounded
    up: rounding moves it by less than 1, so the least is at low or among the last sizes, over which it falls by 1.
    """
    up = lambda x, y: F.ceil(x / F.lit(y))
    need = lambda d: up(F.lit(num) * (n + d), num + den) - up(F.lit(num) * F.greatest(n, d), den) + 1
    low, high = F.greatest(low, up(n * num, den)), F.least(high, F.floor(n * den / num))
    last = -(-den * (num + den) // num**2)
    return F.greatest(F.lit(1), F.least(need(low), *[need(F.greatest(low, high - j)) for j in range(last)]))


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def set_print(s: np.ndarray) -> bytes | None:
    """A fingerprint of a set, none for an empty one."""
    return np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], np.uint64).tobytes() + len(s).to_bytes(8, "big") if len(s) else None


def set_rows(documents: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, fp, block, counts): a row per document, and rows that hold counts of the sketch's blocks."""
    out = arrow("doc_id long, n long, fp binary, block int, counts binary")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, size = np.zeros(CELLS, np.int32), [], 0
        for b in parts:
            sets = shingle_sets(texts_of(b.column(1)), k)
            fps = list(map(set_print, sets))
            none = pa.nulls(b.num_rows)
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=out)
            held += [_cells(s) for s in sets]
            size += sum(map(len, sets))
            if size > 1 << 20:
                sketch += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.int32)
                held, size = [], 0
        if size:
            sketch += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.int32)
        blocks = sketch.reshape(BLOCKS, -1)
        for i in np.flatnonzero(blocks.any(axis=1)).tolist():
            none = pa.nulls(1)
            yield pa.record_batch([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array([i], pa.int32()), pa.array([pa.compress(blocks[i].tobytes(), "zstd", asbytes=True)], pa.binary())], schema=out)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, n long, fp binary, block int, counts binary")


def frequency_sketch(rows: DataFrame) -> np.ndarray:
    """For each cell 8 times the logarithm of its count, in one byte: 2 MB, whatever the corpus."""
    width = CELLS // BLOCKS

    def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in parts:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(pa.decompress(x, width * 4, "zstd"), np.int32).astype(np.int64)
                held[i] = held[i] + x if i in held else x
        for i, x in held.items():
            level = np.minimum(255, np.round(8 * np.log(x + 1.0))).astype(np.uint8)
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "level"])

    sketch = np.zeros(CELLS, np.uint8)
    for r in rows.where("block is not null").select("block", "counts").repartition(BLOCKS // 4, "block").mapInArrow(trimmed(summed), "block int, level binary").collect():  # 64 rows at most
        sketch[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["level"], np.uint8)
    return sketch


def probe_rows(documents: DataFrame, k: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """(doc_id, fp, n, cell, tokens, frequent): a document's rarest tokens, of which any partner shares one, apart by how frequent they are, and its group's key."""
    held = documents.sparkSession.sparkContext.broadcast(sketch)
    step = np.log(den / num)
    many = min(255, round(8 * np.log(FREQUENT)))
    kind = "doc_id long, fp binary, n long, cell long, tokens array<long>, frequent array<long>"
    out = arrow(kind)

    def lists(of: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, of)]).astype(np.int32)), pa.array(np.concatenate(of) if of else np.zeros(0, np.int64)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids, fps, ns, groups, tokens, frequent = [], [], [], [], [], []
            for i, s in zip(b.column(0).to_pylist(), shingle_sets(texts_of(b.column(1)), k), strict=True):
                if len(s) and i is not None:
                    n = len(s)
                    order = (held.value[_cells(s)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                    take = n - least_overlap(n, num, den) + 1
                    rare = np.argpartition(order, take - 1)[:take] if take < n else np.arange(n)
                    band = int(np.log(n) / step)
                    ids.append(i)
                    fps.append(set_print(s))
                    ns.append(n)
                    groups.append(int(mix(np.array([int(mix(s).min()) ^ band], np.uint64))[0].astype(np.int64)))
                    own, often = s[rare].astype(np.int64), held.value[_cells(s[rare])] >= many
                    tokens.append(own[~often])
                    frequent.append(own[often])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(fps, pa.binary()), pa.array(ns, pa.int64()), pa.array(groups, pa.int64()), lists(tokens), lists(frequent)], schema=out)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), kind)


def token_sets(documents: DataFrame, k: int) -> DataFrame:
    """(doc_id, fp, tokens): whole sets, as sorted 64-bit words in one binary value."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            sets = shingle_sets(texts_of(b.column(1)), k)
            yield pa.record_batch([b.column(0), pa.array(map(set_print, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "fp", "tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, fp binary, tokens binary")


def open_groups(ids: list[int], sets: list[np.ndarray], asks: list[int], ask_sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links of a group's members with the queries, as edges of a forest: as many as there are nodes at most."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    union, first = np.unique(flat, return_index=True)
    first = np.append(first, len(flat))
    for q, s in zip(asks, ask_sets, strict=True):
        at = np.searchsorted(union, s)
        at[at == len(union)] = 0
        hit = at[union[at] == s]
        if len(hit) < least_overlap(len(s), num, den):
            continue  # no member can be similar enough
        if len(sets) == 1:
            shared = np.array([len(hit)])
        else:
            n = first[hit + 1] - first[hit]
            shared = np.bincount(owner[np.repeat(first[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        for m in np.flatnonzero(den * shared >= num * (sizes + len(s) - shared)).tolist():
            if ids[m] != q:
                a, b = find(ids[m]), find(q)
                root[max(a, b)] = min(a, b)
    return [(x, r) for x in root if (r := find(x)) != x]


def similar_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) from rows (g, part, query, doc_id, tokens), dealt by (g, part) and sorted with members before queries."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, asks, ask_sets = None, [], [], [], []

        def opened() -> pa.RecordBatch | None:
            if not ids or not asks:
                return None
            edges = open_groups(ids, sets, asks, ask_sets, num, den)
            return pa.record_batch([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], names=["a", "b"]) if edges else None

        for batch in parts:
            for g, p, q, d, t in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (g, p) != key:
                    if (x := opened()) is not None:
                        yield x
                    key, ids, sets, asks, ask_sets = (g, p), [], [], [], []
                (asks if q else ids).append(d)
                (ask_sets if q else sets).append(np.frombuffer(t, np.uint64))
                if len(asks) >= QUERY_ROWS:
                    if (x := opened()) is not None:
                        yield x
                    asks, ask_sets = [], []
        if (x := opened()) is not None:
            yield x

    return rows.mapInArrow(trimmed(run), "a long, b long")


def jaccard_components(documents: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document: links are pairs with a similarity of num/den or more."""
    spark = prepare(documents.sparkSession)
    rows = stored(set_rows(documents, k), "sets")
    sketch = frequency_sketch(rows)
    sets = rows.where("block is null").select("doc_id", "n", "fp")
    own = sets.where("fp is not null and doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("fp"))
    classes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")

    probes = probe_rows(documents, k, num, den, sketch).join(classes.select(F.col("rep").alias("doc_id"), "fp"), ["doc_id", "fp"], "left_semi").dropDuplicates(["doc_id"])
    probes = stored(probes, "probes")
    splits = probes.groupBy("cell").agg(F.ceil(F.greatest(F.count("*") / GROUP_ROWS, F.sum("n") / GROUP_TOKENS)).alias("splits")).where("splits > 1")
    splits = stored(splits, "splits")  # a plain table: the join can then split a hot group's rows
    part = F.when(F.col("splits").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.pmod(F.xxhash64("doc_id"), F.col("splits"))))
    grouped = stored(probes.join(splits, "cell", "left").select("doc_id", "n", "tokens", "frequent", part.alias("g")), "grouped")
    discard(probes, splits)

    def met(column: str) -> DataFrame:
        """(q, qn, g, low, high) for each token of a document and each group of the matrix that has it and may hold a partner."""
        tokens = grouped.select("doc_id", "n", "g", F.explode(column).alias("token"))
        of = F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high")
        if column == "tokens":
            matrix = tokens.repartition("token").groupBy("token", "g").agg(*of)  # the join follows this partitioning
        else:
            matrix = stored(tokens.groupBy("token", "g").agg(*of), "matrix")  # both sides are plain tables, so the join can split a token
        asks = tokens.select("token", F.col("doc_id").alias("q"), F.col("n").alias("qn"), F.col("g").alias("qg"))
        fits = (F.col("qn") * num <= F.col("high") * den) & (F.col("low") * num <= F.col("qn") * den)
        return asks.join(matrix, "token").where((F.col("qg") < F.col("g")) & fits | (F.col("qg") == F.col("g")) & (F.col("members") > 1)).select("q", "qn", "g", "low", "high")

    with scratch() as keep:
        found = met("tokens")
        if not grouped.where(F.size("frequent") > 0).isEmpty():
            found = found.union(met("frequent"))
        found = found.groupBy("q", "g").agg(F.first("qn").alias("qn"), F.count("*").alias("shared"), F.min("low").alias("low"), F.max("high").alias("high"))
        found = keep(stored(found.where(F.col("shared") >= least_shared(F.col("qn"), F.col("low"), F.col("high"), num, den)).select("q", "g"), "candidates"))

    opened = stored(grouped.select("doc_id", "g", "n").join(found.select("g").distinct(), "g", "left_semi"), "members")
    discard(grouped)
    needed = opened.select("doc_id").union(found.select("q")).distinct()
    held = token_sets(semi(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), needed, "doc_id"), k).where("fp is not null")
    whole_sets = stored(held.groupBy("doc_id").agg(F.min_by("tokens", "fp").alias("tokens")), "whole")
    loads = found.groupBy("g").agg(F.count("*").alias("asked")).select("g", F.ceil(F.col("asked") / QUERY_ROWS).alias("parts"))
    members = opened.join(loads, "g").join(whole_sets, "doc_id").select("g", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), F.lit(0).alias("query"), "doc_id", "tokens")
    queries = found.join(loads, "g").withColumnRenamed("q", "doc_id").join(whole_sets, "doc_id").select("g", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("query"), "doc_id", "tokens")
    dealt = members.union(queries).repartition("g", "part").sortWithinPartitions("g", "part", "query", "doc_id")
    links = stored(similar_links(dealt, num, den), "links")
    discard(found, opened, whole_sets)
    linked = components(links, "labels")
    discard(links)

    reps = classes.join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    reps = stored(reps, "representatives")
    discard(classes, linked)
    out = sets.join(reps, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), "fp")
    # rows of a repeated doc_id with other words take the component of the row that stands for it
    twice = stored(sets.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("fp"), F.max("fp").alias("most"), F.count_if(F.col("fp").isNull()).alias("empty")).where("fp <> most or fp is not null and empty > 0").select("doc_id", "fp"), "twice")
    if twice.isEmpty():
        return out.drop("fp")
    stands = twice.join(reps, "fp").select("doc_id", F.col("component").alias("own"))
    return out.join(stands, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("own", "component_id").alias("component_id"))


def drop_similar(documents: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows that stay, with all their columns: of each component the one with the smallest doc_id, and rows whose doc_id is null."""
    with scratch() as keep:
        found = keep(stored(jaccard_components(documents, k, num, den), "similar"))
    return anti(documents, found.where("component_id <> doc_id").select("doc_id"), "doc_id")
