"""The best k rows of a table for each of a stated set of queries, by distance or cosine: an exact join with pivots.

Rows are dealt into cells by the pivot nearest to them. A query meets the cell of its own pivot first; the distance of its
k-th row there rules out every cell whose bound is larger, and it visits the others. Cells are cut into parts and their
queries into blocks, so that both sides of a task are bounded however many rows are alike. Products of matrices choose
candidates, whose exact sums decide. Only pivots and figures of cells come to the driver (PIVOTS at most).

Where distances hardly differ (random vectors of many elements) bounds rule out little and the search is one of all
parts with all blocks. Below CELL rows there is one cell and no second step.

Defined results: a null vector, one with a null element, one whose squared length isn't finite, and one of another length than the query's have no distance and are left out; so are zero
vectors for the cosine. Null ids, of queries or rows, are left out. A query without neighbours has no rows. Distances and scores are rounded to 8 digits; ties go to the smaller
id. Queries and rows that repeat are found as often as they are there. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.session import checkpointed, shipped

#: Rows for each pivot, the most pivots and their bytes.
CELL, PIVOTS, PIVOT_BYTES = 16_384, 1024, 16 << 20
#: Rows and bytes of a part of a cell, queries of a block, and rows that are compared with a block at a time.
PART, PART_BYTES, QUERIES, ROWS = 16_384, 64 << 20, 4096, 512
#: Queries of a block that are in work at a time: a worker's matrices have this many times ROWS elements.
ASKED = 512


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e8 + 0.5) / 1e8


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length among the vectors without nulls."""
    ok = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False))
    column = column.take(pa.array(ok))
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    flat = column.flatten()
    bad = np.repeat(np.arange(len(ok)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)]
    flat = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    good = np.ones(len(ok), bool)
    good[bad] = False
    out = []
    for n in np.unique(sizes[good & (sizes > 0)]).tolist():
        of = np.flatnonzero(good & (sizes == n))
        out.append((ok[of], flat[starts[of][:, None] + np.arange(n)]))
    return out


class Best:
    """The best k rows of each query of a slice: the least values, of ties the smaller id."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, cosine: bool):
        self.q, self.ids, self.k, self.cosine = queries, ids, k, cosine
        self.value, self.row = np.full((len(queries), k), np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
        self.label = np.full((len(queries), k), None, object)
        self.square = (queries * queries).sum(axis=1)

    def add(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Meets the queries with some rows. Whatever may be among the best, give or take rounding, is computed exactly."""
        square = (x * x).sum(axis=1)
        if self.cosine:
            with np.errstate(divide="ignore", invalid="ignore"):
                near = -(self.q @ x.T) / np.sqrt(self.square[:, None] * square[None])
            near[~np.isfinite(near) | (self.ids[:, None] == ids[None])] = np.inf
            limit, slack = self.value[:, -1:], 1e-7
        else:
            near = self.square[:, None] + square[None] - 2 * (self.q @ x.T)
            limit, slack = self.value[:, -1:] ** 2, 1e-6 * (1 + self.square[:, None] + square.max())
        if len(ids) >= self.k:
            limit = np.minimum(limit, np.partition(near, self.k - 1, axis=1)[:, self.k - 1 : self.k])
        a, b = np.nonzero((near <= limit + slack) & np.isfinite(near))
        for at in range(0, len(a), 1 << 15):
            self._exact(x, ids, labels, a[at : at + (1 << 15)], b[at : at + (1 << 15)])

    def _exact(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        if self.cosine:
            value = -_rounded((self.q[a] * x[b]).sum(axis=1) / (np.sqrt(self.square[a]) * np.sqrt((x[b] * x[b]).sum(axis=1))))
        else:
            value = _rounded(np.sqrt(((self.q[a] - x[b]) ** 2).sum(axis=1)))
        touched = np.unique(a)
        who = np.concatenate([a, np.repeat(touched, self.k)])
        value, row, label = (np.concatenate([new, old[touched].ravel()]) for new, old in ((value, self.value), (ids[b], self.row), (labels[b], self.label)))
        order = np.lexsort((row, value, who))
        who = who[order]
        order = order[np.arange(len(who)) - np.searchsorted(who, who) < self.k].reshape(len(touched), self.k)
        self.value[touched], self.row[touched], self.label[touched] = value[order], row[order], label[order]


def _units(m: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / np.sqrt((m * m).sum(axis=1))[:, None]


class Pivots:
    """Distinct vectors of the table, by length. A row belongs to the cell of the pivot nearest to it; lengths without a
    pivot share the cell REST. For the cosine all vectors are scaled to length 1, where near is the same as alike."""

    REST = -1

    def __init__(self, vectors: list[np.ndarray], cosine: bool):
        self.cosine, self.of, at = cosine, {}, 0
        for m in vectors:
            m = np.unique(self.space(m), axis=0)
            m = m[np.isfinite((m * m).sum(axis=1))]
            self.of[m.shape[1]] = (at, m)
            at += len(m)
        self.of = {n: x for n, x in self.of.items() if len(x[1])}
        self.count = at

    def space(self, m: np.ndarray) -> np.ndarray:
        return _units(m) if self.cosine else m

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)))

    def assigned(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of vectors of one length."""
        if m.shape[1] not in self.of:
            return np.full(len(m), self.REST, np.int32), np.zeros(len(m))
        first, p = self.of[m.shape[1]]
        m = self.space(m)
        near = np.concatenate([self.distances(m[i : i + ROWS], p).argmin(axis=1) for i in range(0, len(m), ROWS)])
        return (first + near).astype(np.int32), np.sqrt(((m - p[near]) ** 2).sum(axis=1))

    def reached(self, m: np.ndarray, within: np.ndarray, k: int, least: np.ndarray, most: np.ndarray) -> list[np.ndarray]:
        """For each vector the cells, its own left out, that may hold a row nearer than `within`; least and most are the
        cells' distances to their pivots. Bounds: the triangle inequality, and the plane between two pivots."""
        if m.shape[1] not in self.of:
            return [np.zeros(0, np.int32)] * len(m)
        first, p = self.of[m.shape[1]]
        m, least, most, out = self.space(m), least[first : first + len(p)], most[first : first + len(p)], []
        own = k + self.cosine  # pivots are rows of the table; for the cosine one may be the query itself
        for i in range(0, len(m), ROWS):
            d = self.distances(m[i : i + ROWS], p)
            home = d.argmin(axis=1)
            limit = within[i : i + ROWS]
            if len(p) >= own:
                limit = np.minimum(limit, np.partition(d, own - 1, axis=1)[:, own - 1])
            size = np.sqrt((m[i : i + ROWS] ** 2).sum(axis=1)) + np.sqrt((p * p).sum(axis=1).max())
            apart = self.distances(p[home], p)
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(apart > 1e-3 * size[:, None], (d * d - d[np.arange(len(d)), home][:, None] ** 2) / (2 * apart), 0.0)
            bound = np.maximum(np.maximum(d - most, least - d), plane)
            reach = bound <= (limit + 1e-6 * size + 1e-7)[:, None]
            reach[np.arange(len(d)), home] = False
            out += [(first + np.flatnonzero(r)).astype(np.int32) for r in reach]
        return out


def _pivots(rows: DataFrame, of: int, count: int, cosine: bool) -> Pivots:
    """count distinct vectors at most, those of the lowest hashes."""
    if not count:
        return Pivots([], cosine)
    share = F.lit(float(1 << 53) * min(1.0, (4.0 * count + 100) / of))
    hashed = F.xxhash64("x", F.lit("pivot"))
    some = rows.where(F.shiftrightunsigned(hashed, 11) < share).select("x").distinct().orderBy(hashed).limit(count).toArrow()["x"]
    return Pivots([m for _, m in _vectors(pa.concat_arrays(some.chunks))] if some.num_chunks else [], cosine)


class Search:
    """Steps of one search, each a Spark job: cells, homes, the best of the home cells, further cells, the best of all."""

    def __init__(self, table: DataFrame, queries: DataFrame, k: int, cosine: bool):
        self.k, self.cosine, self.spark = k, cosine, shipped(table).sparkSession
        self.label = dict(table.dtypes).get("label")
        rows = table.where("id is not null and x is not null").select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), *(["label"] if self.label else []))
        asked = queries.where("q is not null and x is not null").select(F.col("q").cast("long").alias("q"), F.col("x").cast("array<double>").alias("x"))
        n, widest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
        count = min(PIVOTS, n // CELL, PIVOT_BYTES // (8 * max(1, widest)))
        self.pivots = _pivots(rows, n, count, cosine)
        self.sent = self.spark.sparkContext.broadcast(self.pivots)
        if self.pivots.count:
            self.rows = checkpointed(self._placed(rows.withColumn("at", F.monotonically_increasing_id()), "r"))
            found = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most"), F.max(F.size("x")).alias("widest")).collect()  # a row for each cell
        else:
            self.rows = rows.withColumns({"at": F.xxhash64("id", "x"), "cell": F.lit(Pivots.REST), "r": F.lit(0.0)})
            found = [{"cell": Pivots.REST, "n": n, "least": 0.0, "most": 0.0, "widest": widest}]
        self.size = {r["cell"]: r["n"] for r in found}
        self.parts = {r["cell"]: max(1, math.ceil(r["n"] / min(PART, max(1, PART_BYTES // (8 * max(1, r["widest"])))))) for r in found}
        self.least, self.most = np.full(self.pivots.count, np.inf), np.full(self.pivots.count, -np.inf)
        for r in found:
            if r["cell"] >= 0:
                self.least[r["cell"]], self.most[r["cell"]] = r["least"], r["most"]
        self.asked = checkpointed(self._placed(asked.withColumn("slot", F.monotonically_increasing_id()), "far"))

    def _placed(self, df: DataFrame, far: str) -> DataFrame:
        """Adds cell and the distance to its pivot; vectors that no distance can be told of go."""
        at, sent, cosine = df.columns.index("x"), self.sent, self.cosine

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                for places, m in _vectors(b.column(at)):
                    square = (m * m).sum(axis=1)
                    good = np.isfinite(square) & ((square > 0) | (not cosine))
                    if good.any():
                        cell, r = sent.value.assigned(m[good])
                        yield pa.record_batch([*b.take(pa.array(places[good])).columns, pa.array(cell), pa.array(r)], names=[*b.schema.names, "cell", far])

        kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
        return df.mapInArrow(run, f"{kinds}, cell int, {far} double")

    def _met(self, visits: DataFrame) -> DataFrame:
        """(q, slot, id, found, label): the best k rows of each query and part of a cell, from visits (cell, slot, q, x).
        Both sides of a task are bounded: a large cell has parts, its queries blocks."""
        asks = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # a row for each cell
        plan = self.spark.createDataFrame([(c, self.parts[c], math.ceil(n / QUERIES)) for c, n in asks.items() if c in self.parts], "cell int, parts int, blocks int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        none = lambda t: F.lit(None).cast(t)
        more = ["label"] if self.label else []
        left = self.rows.join(F.broadcast(plan), "cell").select("cell", F.pmod("at", "parts").cast("int").alias("part"), every("blocks").alias("block"), "id", none("long").alias("slot"), "x", *more)
        right = visits.join(F.broadcast(plan), "cell").select("cell", every("parts").alias("part"), F.pmod(F.xxhash64("slot"), "blocks").cast("int").alias("block"), F.col("q").alias("id"), "slot", "x", *([none(self.label).alias("label")] if self.label else []))
        k, cosine = self.k, self.cosine

        def best_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
            asks = t["slot"].is_valid().to_numpy(zero_copy_only=False)
            sides = [t.filter(pa.array(x)).combine_chunks() for x in (asks, ~asks)]
            flat = lambda c: c.chunk(0) if c.num_chunks else pa.array([], c.type)
            q, rows = ({m.shape[1]: (at, m) for at, m in _vectors(flat(s["x"]))} for s in sides)
            names = ["q", "slot", "id", "found", *more]
            for n in sorted(q.keys() & rows.keys()):
                (a, m), (b, x) = q[n], rows[n]
                own, ids = sides[0]["id"].to_numpy()[a], sides[1]["id"].to_numpy()[b]
                labels = np.array(flat(sides[1]["label"]).take(pa.array(b)).to_pylist(), object) if more else np.full(len(b), None, object)
                slots = sides[0]["slot"].to_numpy()[a]
                for at in range(0, len(m), ASKED):
                    top = Best(m[at : at + ASKED], own[at : at + ASKED], k, cosine)
                    for lo in range(0, len(x), ROWS):
                        top.add(x[lo : lo + ROWS], ids[lo : lo + ROWS], labels[lo : lo + ROWS])
                    i, j = np.nonzero(np.isfinite(top.value))
                    columns = [top.ids[i], slots[at + i], top.row[i, j], top.value[i, j] * (-1.0 if cosine else 1.0)]
                    yield from pa.table([*map(pa.array, columns), *([pa.array(top.label[i, j].tolist(), t.schema.field("label").type)] if more else [])], names=names).to_batches()

        kind = "q long, slot long, id long, found double" + (f", label {self.label}" if more else "")
        schema = pa.schema([("q", pa.int64()), ("slot", pa.int64()), ("id", pa.int64()), ("found", pa.float64())])

        def run(t: pa.Table) -> pa.Table:
            return pa.Table.from_batches(best_of(t), schema=schema.append(t.schema.field("label")) if more else schema)

        return left.unionByName(right).groupBy("cell", "part", "block").applyInArrow(run, kind)

    def _top(self, found: DataFrame) -> DataFrame:
        by = Window.partitionBy("q", "slot").orderBy(F.desc("found") if self.cosine else F.asc("found"), "id")
        return found.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= self.k)

    def further(self, first: DataFrame) -> DataFrame:
        """(slot, q, x, cells) of the queries, with the cells to visit beside their own, from the best rows of that."""
        theirs = first.where(F.col("rn") == self.k).select("slot", "found")
        asked = self.asked.join(theirs, "slot", "left").select("slot", "q", "x", "found")
        sent, k, cosine, least, most = self.sent, self.k, self.cosine, self.least, self.most

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                found = b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)  # null: no k rows at home
                within = np.sqrt(np.maximum(0.0, 2 - 2 * found + 4e-8)) if cosine else found + 1e-8
                within = np.where(np.isnan(within), np.inf, within)
                for at, m in _vectors(b.column(2)):
                    cells = sent.value.reached(m, within[at], k, least, most)
                    ends = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int32)
                    some = b.select([0, 1, 2]).take(pa.array(at))
                    yield pa.record_batch([*some.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cells).astype(np.int32)))], names=["slot", "q", "x", "cells"])

        return asked.mapInArrow(run, "slot long, q long, x array<double>, cells array<int>")

    def result(self) -> DataFrame:
        first = self._top(self._met(self.asked.select("cell", "slot", "q", "x")))
        if not self.pivots.count:
            return first.drop("slot")
        first = checkpointed(first)
        self.visits = checkpointed(self.further(first))
        more = self._met(self.visits.select(F.explode("cells").alias("cell"), "slot", "q", "x"))
        return self._top(first.drop("rn").unionByName(more)).drop("slot")

    def compared(self) -> DataFrame:
        """(q, rows) after result(): how many rows each query was compared with."""
        sizes = F.broadcast(self.spark.createDataFrame(list(self.size.items()), "cell int, n long"))  # a row for each cell
        seen = self.asked.select("slot", "q", "cell")
        if self.pivots.count:
            seen = seen.union(self.visits.select("slot", "q", F.explode("cells")))
        return seen.join(sizes, "cell").groupBy("slot", "q").agg(F.sum("n").alias("rows")).drop("slot")


def best(table: DataFrame, queries: DataFrame, k: int, value: str, cosine: bool = False) -> DataFrame:
    """(q, id, value, rn, and label if the table has it): rows (id, x, label) for queries (q, x). With cosine the greatest
    values, and a row isn't compared with a query of its id."""
    return Search(table, queries, k, cosine).result().withColumnRenamed("found", value)
