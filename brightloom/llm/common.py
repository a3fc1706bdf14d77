"""Helpers the operators share: shared storage, shipping code, key filters and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()

#: Rows and bytes of one Arrow batch; both bound what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches of the session, makes this package importable on executors and, in local mode alone, sets a
    checkpoint folder where none is set. On a cluster a folder that all machines reach has to be set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        top = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(), f"{top.name}_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(path)
    if not spark.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint"))
    return spark


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores so that no column has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if (held := _scope.get()) is not None:
        held.append(out)
    return out


#: Tables stored within the innermost `scratch`.
_scope: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables that were stored within it, but for those given to the function that it yields."""
    outer, own = _scope.get(), []
    token = _scope.set(own)

    def keep(df: DataFrame) -> DataFrame:
        own[:] = [x for x in own if x.stored_at != df.stored_at]
        if outer is not None:
            outer.append(df)
        return df

    try:
        yield keep
    finally:
        _scope.reset(token)
        discard(*own)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def whole(df: DataFrame) -> DataFrame:
    """Checkpointed rows whose partitions and their order stay as they are."""
    return df.checkpoint(eager=True)


def arrow(schema: str) -> pa.Schema:
    """An Arrow schema from 'name type, ...'."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in schema.split(","))])


def give_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches; when a task's rows end, its worker gives freed memory back to the system.

    Workers stay for later tasks, of other stages too, and would otherwise each keep the largest heap that they had.
    """

    def over(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(parts)
        finally:
            give_back()

    return over


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def batches_of(items: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Slices of the list with at most so many bytes each, or one item."""
    start, total = 0, 0
    for i, x in enumerate(items):
        if total and total + len(x) > limit:
            yield start, i
            start, total = i, 0
        total += len(x) + 1
    if start < len(items):
        yield start, len(items)


# ---- Keys in a bitmap of fixed size ------------------------------------------------------------

BITMAP_BITS = 1 << 24
_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    k = keys.astype(np.int64).view(np.uint64)
    return [(mix(k ^ np.uint64(s)) % np.uint64(bits)).astype(np.int64) for s in _SALTS]


def key_bitmap(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A Bloom bitmap over a long column. Its size is fixed (2 MB), whatever the number of keys."""
    blocks = 64
    width = bits // 8 // blocks

    def local(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        seen = False
        for b in parts:
            if b.num_rows:
                seen = True
                for p in _places(b.column(0).to_numpy(zero_copy_only=False), bits):
                    np.bitwise_or.at(bitmap, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
        if seen:
            used = [i for i in range(blocks) if bitmap[i * width : (i + 1) * width].any()]
            yield pa.record_batch([pa.array(used, pa.int32()), pa.array([bitmap[i * width : (i + 1) * width].tobytes() for i in used], pa.binary())], names=["block", "bits"])

    def merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in parts:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint8)
                held[i] = held[i] | x if i in held else x
        if held:
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    rows = keys.select(F.col(column).cast("long").alias("k")).where("k is not null").mapInArrow(trimmed(local), "block int, bits binary").repartition(8, "block").mapInArrow(trimmed(merged), "block int, bits binary").collect()  # 64 blocks at most
    for r in rows:
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(spark: SparkSession, bitmap: np.ndarray, column: Column) -> Column:
    """False where the key surely isn't among those of the bitmap; null keys are never."""
    held = spark.sparkContext.broadcast(bitmap)
    bits = len(bitmap) * 8

    @F.arrow_udf("boolean")
    def found(keys: pa.Array) -> pa.Array:
        ok = ~keys.is_null().to_numpy(zero_copy_only=False)
        for p in _places(keys.fill_null(0).to_numpy(zero_copy_only=False), bits):
            ok &= (held.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return pa.array(ok)

    return found(column.cast("long"))


def semi(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is among the keys. Wide rows are shuffled only if the bitmap lets them pass."""
    keys = keys.select(column).distinct()
    return df.where(in_bitmap(df.sparkSession, key_bitmap(keys, column), F.col(column))).join(keys.hint("merge"), column, "left_semi")


def anti(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key isn't among the keys; most pass without a shuffle."""
    keys = keys.select(column).distinct()
    # null keys are never found, so they pass
    maybe = in_bitmap(df.sparkSession, key_bitmap(keys, column), F.col(column))
    return df.where(~maybe).unionByName(df.where(maybe).join(keys.hint("merge"), column, "left_anti"))


# ---- Components ---------------------------------------------------------------------------------


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for each node of edges (a, b): the smallest node that it reaches.

    Minimum labels spread along edges and jump to the label's own label; each round is written to the shared
    folder, so lineage stays short. Labels and edges stay distributed.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), name)
    labels = last = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), name)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("c"))
        up = labels.select(F.col("node").alias("c"), F.col("component").alias("jump"))
        after = stored(lower.join(up, "c").select("node", "was", F.least("c", "jump").alias("component")), name)
        moved = after.where("component <> was").limit(1).count()
        discard(last)
        labels, last = after.select("node", "component"), after
        if not moved:
            discard(both)
            labels.stored_at = after.stored_at
            return labels
