"""Row numbers without ranking all rows, or all rows of a class, in one task.

Defined results: ranks are gapless from 1. Ties in the order are numbered in any order, so the order should end in a
unique key. Nulls in the order come first, as Spark sorts them; a null bucket is a bucket of its own, before the others. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket of hash digits holds on average.
BUCKET_ROWS = 50_000


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores so that no column has it."""
    while name in df.columns:
        name += "_"
    return name


def ranked(df: DataFrame, bucket: Column, order: list[Column], name: str = "rank", within: Column | None = None) -> DataFrame:
    """Numbers rows from 1 by (bucket, order), in each class of `within` if it is given. Rows are ranked within their bucket; the buckets' starts come from their
    sizes, a table of a row for each bucket. Buckets must follow the order, and be small."""
    b, c, n, s = (free(df, x) for x in ("_bucket", "_class", "_size", "_start"))
    rows = df.withColumns({b: bucket, c: F.lit(0) if within is None else within})
    sizes = rows.groupBy(c, b).agg(F.count("*").alias(n))
    starts = sizes.select(F.struct(F.col(c).alias("c"), F.col(b).alias("b")).alias(n + "k"), (F.sum(n).over(Window.partitionBy(c).orderBy(b)) - F.col(n)).alias(s))
    joined = rows.join(starts, F.col(c).eqNullSafe(F.col(f"{n}k.c")) & F.col(b).eqNullSafe(F.col(f"{n}k.b")))
    return joined.withColumn(name, F.col(s) + F.row_number().over(Window.partitionBy(c, b).orderBy(*order))).drop(b, c, s, n + "k")


def digits_for(rows: int) -> int:
    """Hexadecimal digits of a hash that part so many rows into buckets of about BUCKET_ROWS."""
    return max(1, math.ceil(math.log(max(1, rows) / BUCKET_ROWS, 16)))
