"""The join over boxes against brute force, and how much of the table it meets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.operators import boxes, learning


def test_votes_by_brute_force_over_many_cells(spark):
    rng = np.random.default_rng(5)
    x = np.c_[rng.integers(0, 60, 900), rng.integers(0, 9, 900), np.zeros(900)].astype(float)
    x[::3] = [7, 3, 0]  # a third of the rows are alike
    y, fold = rng.integers(0, 2, 900), rng.integers(0, 5, 900)
    rows = spark.createDataFrame([(i, int(fold[i]), int(y[i]), *x[i].tolist()) for i in range(900)], "id long, fold int, y int, label double, id2 double, x double").repartition(3)
    asked = rows.select(F.col("id").alias("q"), F.when(F.col("id") % 4 > 0, F.col("fold")).otherwise(-1).alias("fold"), "label", "id2", "x")
    got = {r["q"]: (r["k5"], r["k7"]) for r in learning.neighbour_votes(rows, asked, [5, 7], ["label", "id2", "x"], block=20).collect()}
    assert len(got) == 900
    for i in range(900):
        d = ((x - x[i]) ** 2).sum(axis=1)
        near = [j for j in np.lexsort((np.arange(900), d)) if i % 4 == 0 or fold[j] != fold[i]]
        assert got[i] == pytest.approx((y[near[:5]].mean(), y[near[:7]].mean()))


def test_cells_that_are_met_do_not_grow_with_the_rows():
    rng = np.random.default_rng(6)
    seen = []
    for n in (4000, 32000):
        x = np.c_[rng.integers(0, 100_000, n), rng.exponential(100, n), rng.exponential(20, n)]
        tree = boxes.Tree(x[: n // 10], n // 200)
        cell = tree.place(x)
        tree.bound({int(c): (x[cell == c].min(axis=0), x[cell == c].max(axis=0)) for c in np.unique(cell)}, 3)
        within = np.concatenate([np.partition(((x[i] - x[cell == cell[i]]) ** 2).sum(axis=1), 7)[7:8] for i in range(500)])
        met = tree.reached(x[:500], within, cell[:500])[1]
        size = np.bincount(cell)
        seen.append((size[cell[:500]].sum() + size[met].sum()) / 500)
    assert seen[1] < 2 * seen[0] and seen[1] < 0.2 * 32000


def test_training_rows_are_written_once(spark, data):
    from brightloom.plans import catalog

    train, test = catalog._training(spark, data)
    for df in (train, test):
        assert "parquet" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_forests_keep_node_ids(spark):
    """Else each level walks all rows down all trees."""
    assert learning.classifier("forest", "y", maxDepth=30).getCacheNodeIds()


def test_a_search_works_on_a_bounded_matrix(spark):
    from brightloom.operators import nearest

    assert nearest.ASKED * nearest.ROWS <= 1 << 18
    rng = np.random.default_rng(7)
    x = rng.integers(0, 5, (700, 3)).astype(float)  # more queries than are in work at a time, many ties
    table = spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(700)], "id long, x array<double>, label int")
    got = {}
    for r in nearest.best(table, table.select(F.col("id").alias("q"), "x"), 3, "d").collect():
        got.setdefault(r["q"], []).append((r["rn"], r["id"], r["label"]))
    for i in range(700):
        near = np.lexsort((np.arange(700), ((x - x[i]) ** 2).sum(axis=1)))[:3].tolist()
        assert sorted(got[i]) == [(n + 1, j, j % 3) for n, j in enumerate(near)]
