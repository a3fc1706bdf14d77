"""Exact trees and stumps of several classes against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brightloom.operators import cart, learning


def plain_tree(rows, names, depth, kind, node=1):
    """{node: (feature, threshold)} of an exact tree over (x, y, w) rows, and {leaf: prediction}."""

    def impurity(part):
        n = sum(w for *_, w in part)
        if kind == "mean":
            mean = sum(y for _, y, _ in part) / n
            return sum((y - mean) ** 2 for _, y, _ in part)
        by = Counter()
        for _, y, w in part:
            by[y] += w
        return n * (1 - sum((v / n) ** 2 for v in by.values()))

    by = Counter()
    for _, y, w in rows:
        by[y] += w
    best = None
    if depth and len(by) > 1:
        for j, f in enumerate(names):
            values = sorted({x[j] for x, *_ in rows})
            for a, b in zip(values, values[1:]):
                left, right = ([r for r in rows if (r[0][j] <= a) == side] for side in (True, False))
                found = (round((impurity(left) + impurity(right)) / sum(r[2] for r in rows), 10), f, (a + b) / 2, left, right)
                best = found if best is None or found[:3] < best[:3] else best
    if best is None:
        return {}, {node: sum(y for _, y, _ in rows) / len(rows) if kind == "mean" else min(k for k, v in by.items() if v == max(by.values()))}
    _, f, threshold, left, right = best
    s1, l1 = plain_tree(left, names, depth - 1, kind, 2 * node)
    s2, l2 = plain_tree(right, names, depth - 1, kind, 2 * node + 1)
    return {node: (f, threshold), **s1, **s2}, {**l1, **l2}


def drawn(seed, n=150, k=3):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        x = (float(rnd.randrange(9)), rnd.gauss(0, 1), float(rnd.randrange(3)))
        out.append((x, (int(x[0] > 3) + int(x[1] > 0.3) + (rnd.random() < 0.2)) % k, float(rnd.randrange(1, 4))))
    return out


@pytest.mark.parametrize(("seed", "depth", "ranges"), [(1, 3, 100_000), (2, 5, 20)])
def test_classification_trees_by_plain_loops(spark, monkeypatch, seed, depth, ranges):
    monkeypatch.setattr(learning, "STUMP_ROWS", ranges)
    rows = drawn(seed)
    df = spark.createDataFrame([(*x, f"c{y}", w, 1, "s") for x, y, w in rows], "a double, b double, c double, y string, w double, node int, feature string").repartition(3)
    got = cart.classification_tree(df, ["a", "b", "c"], "y", depth, "w")
    splits, leaves = plain_tree([(x, f"c{y}", w) for x, y, w in rows], "abc", depth, "classes")
    assert {n: (x.feature, pytest.approx(x.threshold)) for n, x in got.nodes.items() if x.feature} == splits
    found = df.select(got.leaf().alias("leaf"), got.predict().alias("pred"), got.probability("c1").alias("p")).distinct().collect()
    assert {r["leaf"]: r["pred"] for r in found} == leaves and all(0 <= r["p"] <= 1 for r in found)
    assert sum(w for _, f, _, w in got.table() if f is None) == pytest.approx(sum(w for *_, w in rows))


def test_regression_trees_by_plain_loops(spark):
    rows = [(x, y * 1.5 + x[0], 1.0) for x, y, _ in drawn(3, 120)]
    df = spark.createDataFrame([(*x, y) for x, y, _ in rows], "a double, b double, c double, y double").repartition(3)
    got = cart.regression_tree(df, ["a", "b", "c"], "y", 4)
    splits, leaves = plain_tree(rows, "abc", 4, "mean")
    assert {n: (x.feature, pytest.approx(x.threshold)) for n, x in got.nodes.items() if x.feature} == splits
    assert {r["leaf"]: r["pred"] for r in df.select(got.leaf().alias("leaf"), got.predict().alias("pred")).distinct().collect()} == {k: pytest.approx(v) for k, v in leaves.items()}


def test_trees_of_odd_tables(spark):
    kind = "a double, b double, y int, w double"
    rows = [(1.0, None, 1, 1.0), (float("nan"), 1.0, 1, 1.0), (1.0, 2.0, None, 1.0), (1.0, 2.0, 0, None), (1.0, 2.0, 0, 1.0), (2.0, 2.0, 1, 1.0), (2.0, 2.0, 1, 1.0)]
    df = spark.createDataFrame(rows, kind)
    tree = cart.classification_tree(df, ["a", "b"], "y", 3, "w")
    assert tree.table() == [(1, "a", 1.5, 3.0), (2, None, None, 1.0), (3, None, None, 2.0)]
    assert [r[0] for r in df.limit(2).select(tree.predict()).collect()] == [0, 1]  # nan is above all numbers, so it goes right
    assert cart.classification_tree(df.where("y = 1"), ["b"], "y").table() == [(1, None, None, 3.0)]
    for make in (cart.classification_tree, cart.regression_tree):
        none = make(df.limit(0), ["a", "b"])
        assert none.table() == [] and df.select(none.predict().alias("p")).distinct().collect()[0]["p"] is None
    with pytest.raises(ValueError):
        cart.classification_tree(spark.range(200).select(F.col("id").cast("double").alias("a"), F.col("id").alias("y")), ["a"])


def test_boosting_three_classes_by_plain_loops(spark):
    rows = drawn(5, 120)
    df = spark.createDataFrame([(i, *x, y) for i, (x, y, _) in enumerate(rows)], "id int, a double, b double, c double, y int").repartition(3)
    model = learning.adaboost(df, "id", ["a", "b", "c"], rounds=6)
    w = [1.0] * len(rows)
    for f, threshold, left, right, alpha in model:
        splits, leaves = plain_tree([(x, y, v) for (x, y, _), v in zip(rows, w)], "abc", 1, "classes")
        assert (f, threshold) == (splits[1][0], pytest.approx(splits[1][1])) and (left, right) == (leaves[2], leaves[3])
        wrong = [(left if x["abc".index(f)] <= threshold else right) != y for x, y, _ in rows]
        e = sum(v for v, bad in zip(w, wrong) if bad) / sum(w)
        assert e < 2 / 3 and alpha == pytest.approx(math.log((1 - e) / e) + math.log(2))
        total = sum(w)
        w = [v * (math.exp(alpha) if bad else 1.0) / total for v, bad in zip(w, wrong)]
    assert len(model) == 6 and len({c for _, _, a, b, _ in model for c in (a, b)}) == 3
    votes = [Counter() for _ in rows]
    for f, threshold, left, right, alpha in model:
        for v, (x, *_) in zip(votes, rows):
            v[left if x["abc".index(f)] <= threshold else right] += alpha
    want = [min(k for k, s in v.items() if s >= max(v.values()) - 1e-12) for v in votes]
    assert [r["p"] for r in df.orderBy("id").select(learning.boosted(model).alias("p")).collect()] == want


def test_no_stump_without_labels_or_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, y int")
    assert learning.stump(df, ["a"]).count() == 0 and learning.adaboost(df.withColumn("id", F.lit(1)), "id", ["a"]) == []
    assert df.select(learning.boosted([]).alias("p")).distinct().collect()[0]["p"] is None
    text = spark.createDataFrame([(float(i), "abc"[i // 3]) for i in range(9)], "a double, y string")
    assert tuple(learning.stump(text, ["a"]).first()) == ("a", 2.5, pytest.approx(1 / 3), "a", "b")


def test_two_interleaved_half_moons(spark):
    """Points in two classes, of the shape of the 500 recorded ones: the trees are the plain ones, and right on nearly all."""
    rnd = random.Random(42)
    turn = [(rnd.random() * math.pi, i % 2) for i in range(300)]
    rows = [((math.cos(a) + rnd.gauss(0, 0.15), math.sin(a) + rnd.gauss(0, 0.15)) if y == 0 else (1 - math.cos(a) + rnd.gauss(0, 0.15), 0.5 - math.sin(a) + rnd.gauss(0, 0.15)), y, 1.0) for a, y in turn]
    df = spark.createDataFrame([(*x, y) for x, y, _ in rows], "X1 double, X2 double, y int")
    for depth in (3, 4):
        tree = cart.classification_tree(df, ["X1", "X2"], "y", depth)
        assert {n: (x.feature, pytest.approx(x.threshold)) for n, x in tree.nodes.items() if x.feature} == plain_tree(rows, ["X1", "X2"], depth, "classes")[0]
        assert df.where(tree.predict() == F.col("y")).count() >= 0.88 * len(rows)
