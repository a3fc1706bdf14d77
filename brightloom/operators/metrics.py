"""Metrics as aggregations over (y_true, y_pred).

Defined results: rows with a null in either column don't count. Without rows, errors and accuracy are null, ratios 0 or null, and the
confusion table is empty. Rows that repeat count as often as they are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def _paired(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull())


def confusion(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(y_true, y_pred, n) over all pairs of classes, those without rows included. The classes are few, so pairing them is bounded."""
    counts = _paired(df, y, p).groupBy(y, p).agg(F.count("*").alias("n"))
    classes = F.array_sort(F.array_union(F.collect_set(y), F.collect_set(p)))
    grid = counts.agg(classes.alias("c")).select(F.explode("c").alias(y), "c").select(y, F.explode("c").alias(p))
    return grid.join(counts, [y, p], "left").select(y, p, F.coalesce("n", F.lit(0)).alias("n"))


def accuracy(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def binary_prf(df: DataFrame, positive: int = 1, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    t, q = F.col(y) == positive, F.col(p) == positive
    s = _paired(df, y, p).agg(F.count_if(t & q).alias("tp"), F.count_if(~t & q).alias("fp"), F.count_if(t & ~q).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def weighted_prf(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    c = confusion(df, y, p)
    per = c.groupBy(F.col(y).alias("k")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0)).alias("tp"))
    per = per.join(c.groupBy(F.col(p).alias("k")).agg(F.sum("n").alias("predicted")), "k")
    w = F.col("support") / F.sum("support").over(Window.partitionBy(F.lit(1)))  # one row for each class
    per = per.withColumn("w", w)
    return per.agg(F.sum(F.col("w") * ratio(F.col("tp"), F.col("predicted"))).alias("precision"), F.sum(F.col("w") * ratio(F.col("tp"), F.col("support"))).alias("recall"), F.sum(F.col("w") * ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))).alias("f1"))


def tp_fn(df: DataFrame, label: int, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    t = F.col(y) == label
    return df.agg(F.count_if(t & (F.col(p) == label)).alias("tp"), F.count_if(t & (F.col(p) != label)).alias("fn"))


def rmse(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2))).alias("rmse"))


def rmse_all_pairs(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Over each truth with each forecast, from sums alone: mean((p-y)^2) = mean(p^2) - 2 mean(p) mean(y) + mean(y^2)."""
    a, b = F.col(y), F.col(p)
    return _paired(df, y, p).agg(F.sqrt(F.avg(b * b) - 2 * F.avg(a) * F.avg(b) + F.avg(a * a)).alias("rmse"))


def best(scores: DataFrame, score: str = "score", order: str = "ord") -> DataFrame:
    """The row with the highest score; of ties the first in the order."""
    return scores.orderBy(F.desc(score), order).limit(1)


def hard_vote(predictions: DataFrame, key: str = "id", p: str = "pred") -> DataFrame:
    """(key, vote): the most frequent prediction, of ties the smallest."""
    counts = predictions.groupBy(key, p).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(p).alias("p")))["p"].alias("vote"))
