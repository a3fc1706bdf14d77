"""The nearest rows in few dimensions, each query leaving out the rows of its own fold: an exact join over the boxes of a k-d tree.

Rows that are alike in all features and the fold are cut to the k of the smallest ids, as no others can be among the best k, and
queries that are alike are asked once. A tree over a bounded sample parts the rows into cells of about `cell` rows. A query meets
its own cell first; its k-th distance there rules out every cell whose box is further away. Cells with many rows have parts and
their queries blocks, so both sides of a task are bounded. Only the sample and the cells' boxes come to the driver (CELLS at most).

A box's bound is summed in the order of the features, as distances are, so rounding never makes it larger than a distance in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.session import checkpointed, shipped

#: Rows of a cell, the most cells, and sampled points for each of them.
CELL, CELLS, SAMPLED = 2048, 8192, 8
#: Rows of a part of a cell and queries of a block, as multiples of a cell's rows; queries that are compared at a time.
PART, BLOCK, QUERIES = 8, 2, 256


class Tree:
    """A k-d tree over distinct points. Inner nodes have a feature and a cut; values up to the cut go left. Leaves are cells."""

    def __init__(self, points: np.ndarray, cells: int):
        self.by, self.cut, self.left, self.right, self.cell = [], [], [], [], []
        self.cells = 0
        most = max(1, math.ceil(len(points) / max(1, cells)))
        self._grow(points, most)
        self.by, self.left, self.right, self.cell = (np.array(a, np.int64) for a in (self.by, self.left, self.right, self.cell))
        self.cut = np.array(self.cut, np.float64)
        self.low = self.high = None

    def _grow(self, points: np.ndarray, most: int) -> int:
        at = len(self.by)
        for a, v in ((self.by, -1), (self.cut, np.inf), (self.left, -1), (self.right, -1), (self.cell, -1)):
            a.append(v)
        if len(points) > most:
            j = int((points.max(axis=0) - points.min(axis=0)).argmax())
            values = np.sort(points[:, j])
            cut = values[(len(values) - 1) // 2]
            if cut == values[-1]:  # the middle is the largest value: what lies below it goes left
                cut = values[np.searchsorted(values, cut) - 1]
            goes = points[:, j] <= cut
            self.by[at], self.cut[at] = j, cut
            self.left[at] = self._grow(points[goes], most)
            self.right[at] = self._grow(points[~goes], most)
        else:
            self.cell[at] = self.cells
            self.cells += 1
        return at

    def place(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        node = np.zeros(len(x), np.int64)
        on = np.flatnonzero(self.by[node] >= 0)
        while len(on):
            n = node[on]
            node[on] = np.where(x[on, self.by[n]] <= self.cut[n], self.left[n], self.right[n])
            on = on[self.by[node[on]] >= 0]
        return self.cell[node]

    def bound(self, boxes: dict[int, tuple[list[float], list[float]]], width: int) -> None:
        """Boxes of the cells' rows; cells without rows have none, and inner nodes have those of their children."""
        self.low, self.high = np.full((len(self.by), width), np.inf), np.full((len(self.by), width), -np.inf)
        for n in range(len(self.by) - 1, -1, -1):  # children come after their node
            if self.by[n] >= 0:
                sides = [self.left[n], self.right[n]]
                self.low[n], self.high[n] = self.low[sides].min(axis=0), self.high[sides].max(axis=0)
            elif (box := boxes.get(int(self.cell[n]))) is not None:
                self.low[n], self.high[n] = box

    def reached(self, x: np.ndarray, within: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) for the cells with a box no further than `within`, a squared distance; their own left out."""
        q, n = np.arange(len(x)), np.zeros(len(x), np.int64)
        out = []
        while len(q):
            bound = np.zeros(len(q))
            for j in range(x.shape[1]):
                at = x[q, j]
                bound += np.maximum(np.maximum(self.low[n, j] - at, at - self.high[n, j]), 0.0) ** 2
            near = (bound <= within[q]) & (bound < np.inf)
            q, n = q[near], n[near]
            leaf = self.by[n] < 0
            out.append((q[leaf], self.cell[n[leaf]]))
            q, n = q[~leaf], n[~leaf]
            q, n = np.concatenate([q, q]), np.concatenate([self.left[n], self.right[n]])
        q, c = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        other = c != home[q]
        return q[other], c[other]


def _points(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _tree(rows: DataFrame, n: int, cell: int, width: int) -> Tree:
    """Over the points of the lowest hashes."""
    cells = min(CELLS, n // cell)
    if cells < 2:
        return Tree(np.zeros((0, width)), 1)
    want = cells * SAMPLED
    hashed = F.xxhash64("x", F.lit("cell"))
    share = F.lit(float(1 << 53) * min(1.0, (2.0 * want + 1000) / n))
    some = rows.where(F.shiftrightunsigned(hashed, 11) < share).select("x").distinct().orderBy(hashed).limit(want).toArrow()["x"]
    return Tree(_points(some, width), cells)


def _placed(df: DataFrame, tree, width: int) -> DataFrame:  # noqa: ANN001
    at = df.columns.index("x")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            cell = tree.value.place(_points(b.column(at), width))
            yield pa.record_batch([*b.columns, pa.array(cell.astype(np.int32))], names=[*b.schema.names, "cell"])

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", cell int")


def _met(rows: DataFrame, visits: DataFrame, sizes: dict[int, int], k: int, cell: int, width: int) -> DataFrame:
    """(slot, id, label, d): the best k rows of each query and part of a cell, from visits (cell, slot, fold, x, within)."""
    spark = rows.sparkSession
    asks = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # a row for each cell
    plan = [(c, math.ceil(sizes[c] / (PART * cell)), math.ceil(n / (BLOCK * cell))) for c, n in asks.items() if c in sizes]
    plan = F.broadcast(spark.createDataFrame(plan, "cell int, parts int, blocks int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    left = rows.join(plan, "cell").select("cell", part("id", "parts").alias("part"), every("blocks").alias("block"), none("long", "slot"), "id", "fold", "label", none("double", "within"), "x")
    right = visits.join(plan, "cell").select("cell", every("parts").alias("part"), part("slot", "blocks").alias("block"), "slot", none("long", "id"), "fold", none("int", "label"), "within", "x")
    out = pa.schema([("slot", pa.int64()), ("id", pa.int64()), ("label", pa.int32()), ("d", pa.float64())])

    def near(table: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = table["slot"].is_valid().to_numpy()
        xs, folds = _points(table["x"], width), table["fold"].to_numpy()
        t, q = np.flatnonzero(~asks), np.flatnonzero(asks)
        if not len(t):
            return
        ids, slots = table["id"].fill_null(0).to_numpy(), table["slot"].fill_null(0).to_numpy()
        t = t[np.argsort(ids[t], kind="stable")]
        labels, within = table["label"].fill_null(0).to_numpy()[t], table["within"].fill_null(np.inf).to_numpy()
        for at in range(0, len(q), QUERIES):
            some = q[at : at + QUERIES]
            d = np.zeros((len(some), len(t)))
            for j in range(width):
                d += (xs[some, j][:, None] - xs[t, j][None]) ** 2
            d[folds[some][:, None] == folds[t][None]] = np.inf
            limit = within[some][:, None]
            if len(t) > k and not np.isfinite(limit).all():
                limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1 : k])
            r, c = np.nonzero((d <= limit) & (d < np.inf))
            by = np.lexsort((c, d[r, c], r))
            r, c = r[by], c[by]
            best = np.arange(len(r)) - np.searchsorted(r, r) < k
            r, c = r[best], c[best]
            yield pa.record_batch([slots[some][r], ids[t][c], labels[c].astype(np.int32), d[r, c]], schema=out)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(near(table), schema=out)

    return left.unionByName(right).groupBy("cell", "part", "block").applyInArrow(run, "slot long, id long, label int, d double")


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("slot").orderBy("d", "id")
    return found.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= k)


def nearest(train: DataFrame, query: DataFrame, k: int, features: list[str], cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(slot, id, label, d, rn), the k nearest rows of train (id, fold, label, features) whose fold isn't the query's, and
    (slot, fold, features) of the distinct queries (fold, features). Ties go to the smaller id. Rows and queries with a
    null, NaN or infinite feature have no distance and are left out."""
    width = len(features)
    shipped(train)
    finite = F.lit(True)
    for c in features:
        finite &= F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < F.lit(math.inf))
    doubles = [F.col(c).cast("double").alias(c) for c in features]
    x = F.array(*map(F.col, features)).alias("x")
    alike = Window.partitionBy("fold", *features).orderBy("id")
    rows = train.select(F.col("id").cast("long").alias("id"), F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label"), *doubles).where(finite)
    rows = rows.withColumn("_rn", F.row_number().over(alike)).where(F.col("_rn") <= k).select("id", "fold", "label", x)
    rows = checkpointed(rows)
    spark = rows.sparkSession
    tree = _tree(rows, rows.count(), cell, width)
    sent = spark.sparkContext.broadcast(tree)
    rows = checkpointed(_placed(rows, sent, width))
    at = lambda f, j: f(F.element_at("x", j + 1))
    edges = lambda f: F.array(*(at(f, j) for j in range(width)))
    held = rows.groupBy("cell").agg(F.count("*").alias("n"), edges(F.min).alias("low"), edges(F.max).alias("high")).collect()  # a row for each cell
    tree.bound({r["cell"]: (r["low"], r["high"]) for r in held}, width)
    sizes = {r["cell"]: r["n"] for r in held}
    sent = spark.sparkContext.broadcast(tree)

    asked = query.select(F.col("fold").cast("int").alias("fold"), *doubles).where(finite).distinct()
    asked = checkpointed(asked.withColumn("slot", F.monotonically_increasing_id()))
    homes = checkpointed(_placed(asked.select("slot", "fold", x), sent, width))
    first = checkpointed(_top(_met(rows, homes.withColumn("within", F.lit(None).cast("double")), sizes, k, cell, width), k))
    if tree.cells < 2:
        return first, asked
    known = first.where(F.col("rn") == k).select("slot", F.col("d").alias("within"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            within = b.column(4).fill_null(np.inf).to_numpy(zero_copy_only=False)
            q, c = sent.value.reached(_points(b.column(2), width), within, b.column(3).to_numpy())
            yield pa.record_batch([pa.array(c.astype(np.int32)), *(a.take(pa.array(q)) for a in (b.column(0), b.column(1), b.column(2), b.column(4)))], names=["cell", "slot", "fold", "x", "within"])

    visits = homes.join(known, "slot", "left").select("slot", "fold", "x", "cell", "within").mapInArrow(run, "cell int, slot long, fold int, x array<double>, within double")
    more = _met(rows, checkpointed(visits), sizes, k, cell, width)
    return _top(first.drop("rn").unionByName(more), k), asked


def share(label: Column, k: int) -> Column:
    """The mean label of the k nearest."""
    return F.avg(F.when(F.col("rn") <= k, label.cast("double")))
