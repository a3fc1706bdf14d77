"""Tables laid out for lookups, joins and writes that touch a part of them.

An indexed table is bucketed and sorted by its keys, so that joins on them need no exchange, has Bloom filters in its Parquet
files for columns that are looked up by value, and stores columns that compare in any case in lower case too, so that the
comparison reaches the files. A table in key buckets is a folder for each hash of the key; a write reads and replaces the folders
of the keys that it names, and all other files stay as they are.

Defined results: null keys have a bucket of their own hash. A hot key's bucket has several files. Folders left empty are deleted; keys
that the table lacks touch their bucket all the same; no keys touch nothing. A table that has a column of a helper's name is refused, as is
a change that gives rows of buckets that it didn't name. Replaced folders are staged beside the table and moved at the end; one writer at
a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.session import checkpointed

from .tables import delete_paths

BUCKET, FOLDED = "key_bucket", "{}_folded"


def _added(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    if taken := sorted(set(map(str.lower, columns)) & set(map(str.lower, df.columns))):
        raise ValueError(f"the table has columns of these names: {', '.join(taken)}")
    return df.withColumns(columns)


def write_indexed(df: DataFrame, name: str, keys: list[str], buckets: int, bloom: tuple[str, ...] = (), folded: tuple[str, ...] = ()) -> None:
    """A managed table bucketed by its keys. `folded` columns get a second one in lower case, with a Bloom filter."""
    df = _added(df, {FOLDED.format(c): F.lower(c) for c in folded})
    # a rebalance splits buckets that are too large for one task
    writer = df.hint("rebalance", buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    for c in (*bloom, *map(FOLDED.format, folded)):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.saveAsTable(name)


def found(table: DataFrame, column: str, value: str, folded: bool = False) -> DataFrame:
    """The rows with a value, in any case if the column is stored so; the filter reaches the files."""
    return table.where(F.col(FOLDED.format(column)) == value.lower()) if folded else table.where(F.col(column) == value)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    _added(df, {BUCKET: _bucket(F.col(key), buckets)}).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def change_buckets(spark: SparkSession, path: str, key: str, buckets: int, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Applies a change of snapshots to the buckets of the keys, and returns these. `change` sees all rows of the buckets; the
    number of buckets is the one that the table was written with."""
    table = spark.read.parquet(path)
    typed = F.col(key).cast(table.schema[key].dataType)
    touched = sorted(r[0] for r in keys.select(_bucket(typed, buckets).alias("b")).distinct().collect())  # as many as buckets at most
    if not touched:
        return []
    new = change(table.where(F.col(BUCKET).isin(touched)).drop(BUCKET)).withColumn(BUCKET, _bucket(F.col(key), buckets))
    new = checkpointed(new)
    held = {r[0] for r in new.select(BUCKET).distinct().collect()}
    if not held <= set(touched):
        raise ValueError("the change gives rows of buckets that none of the keys has")
    new.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    delete_paths(spark, [f"{path}/{BUCKET}={b}" for b in touched if b not in held])
    return touched
