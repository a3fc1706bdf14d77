"""Exact classification and regression trees, grown level by level.

A level is one job for all its open nodes: rows find their node by the splits so far, equal values are summed for each node
and feature, running sums over value ranges give every split between neighbouring values, and the best of each node comes
back. Nothing is binned or sampled. A tree of depth d has 2^d leaves at most, so it fits the driver; rows never leave the
executors. They are written once before the first level.

Splits minimise the Gini impurity of the classes, or the variance of the numbers; of equal scores (to 12 digits) the first
feature by name and the smallest threshold count. A node is a leaf if it is pure, has one value of each feature, or lies at the
greatest depth.

Defined results: rows with a null or NaN feature, or a null label or weight, aren't learned from; where a row to be predicted
has a null feature it goes right. Of equally heavy classes the first counts. Rows that repeat count each time. Without rows
every prediction is null. Helper columns never clash, as only features and label are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.session import checkpointed

from .learning import class_sums, classes_of, gini, splits, value_edges


def variance(left: list[Column], right: list[Column]) -> Column:
    """The mean squared error around either side's mean, from (rows, sum, sum of squares)."""
    side = lambda x: x[2] - x[1] * x[1] / x[0]
    return (side(left) + side(right)) / (left[0] + right[0])


@dataclass
class Node:
    sums: list[float]
    feature: str | None = None
    threshold: float = 0.0


@dataclass
class Tree:
    """Nodes by number: 1 is the root, n has the children 2n and 2n + 1. classes is None for numbers."""

    nodes: dict[int, Node]
    classes: list | None

    def leaf(self) -> Column:
        """The number of the leaf that a row falls into."""
        return self._walk(1, lambda n, _: F.lit(n))

    def predict(self) -> Column:
        """The class, or the mean, of the leaf."""
        return self._walk(1, lambda _, x: F.lit(self.classes[x.sums.index(max(x.sums))] if self.classes is not None else x.sums[1] / x.sums[0])) if self.nodes else F.lit(None).cast("double")

    def probability(self, label: object) -> Column:
        """The class's share of the leaf's weight."""
        k = self.classes.index(label)
        return self._walk(1, lambda _, x: F.lit(x.sums[k] / sum(x.sums)))

    def table(self) -> list[tuple[int, str | None, float | None, float]]:
        """(node, feature, threshold, weight), leaves without a feature."""
        return [(n, x.feature, x.threshold if x.feature else None, float(sum(x.sums) if self.classes is not None else x.sums[0])) for n, x in sorted(self.nodes.items())]

    def _walk(self, n: int, at: Callable[[int, Node], Column]) -> Column:
        x = self.nodes[n]
        if x.feature is None:
            return at(n, x)
        return F.when(F.col(x.feature) <= x.threshold, self._walk(2 * n, at)).otherwise(self._walk(2 * n + 1, at))


def _grown(rows: DataFrame, features: list[str], sums: list[str], impurity: Callable[[list[Column], list[Column]], Column], impure: Callable[[list[float]], bool], depth: int, classes: list | None) -> Tree:
    rows = checkpointed(rows)
    total = rows.agg(*[F.sum(m).alias(m) for m in sums]).first()
    if total[0] is None:
        return Tree({}, classes)
    tree = Tree({1: Node([float(x) for x in total])}, classes)
    edges = value_edges(rows, features)
    opened = {1} if impure(tree.nodes[1].sums) else set()
    for _ in range(depth):
        if not opened:
            break
        own = rows.withColumn("node", tree.leaf()).where(F.col("node").isin(sorted(opened)))
        best = splits(own, features, sums, impurity, edges).groupBy("node").agg(F.min(F.struct("score", "feature", "threshold", "left", "total")).alias("s")).select("node", "s.*").collect()  # a row for each open node
        opened = set()
        for r in best:
            x, n = tree.nodes[r["node"]], r["node"]
            x.feature, x.threshold = r["feature"], r["threshold"]
            for child, own_sums in ((2 * n, list(r["left"])), (2 * n + 1, [t - v for t, v in zip(r["total"], r["left"], strict=True)])):
                tree.nodes[child] = Node(own_sums)
                if impure(own_sums):
                    opened.add(child)
    return tree


def _known(df: DataFrame, features: list[str], others: list[Column]) -> DataFrame:
    usable = [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features]
    return df.where(reduce(and_, [*usable, *(c.isNotNull() for c in others)]))


def classification_tree(df: DataFrame, features: list[str], label: str = "y", depth: int = 4, weight: str | None = None) -> Tree:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = _known(df, features, [F.col(label), w])
    classes = classes_of(known, label)
    names = [f"c{i}" for i in range(len(classes))]
    if not names:
        return Tree({}, classes)
    return _grown(known.select(*features, *class_sums(label, classes, w)), features, names, gini, lambda x: sum(v > 0 for v in x) > 1, depth, classes)


def regression_tree(df: DataFrame, features: list[str], label: str = "y", depth: int = 5) -> Tree:
    y = F.col(label).cast("double")
    rows = _known(df, features, [y]).select(*features, F.lit(1.0).alias("m0"), y.alias("m1"), (y * y).alias("m2"))
    return _grown(rows, features, ["m0", "m1", "m2"], variance, lambda x: x[2] / x[0] - (x[1] / x[0]) ** 2 > 1e-12, depth, None)
