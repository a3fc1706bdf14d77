"""Exact deduplication by composable polynomial fingerprints.

A text without its white space is cut into chunks. Each chunk has a polynomial hash; hashes of neighbours combine by
h(xy) = h(x) + B^len(x) * h(y). A text of up to HUGE bytes is hashed where it lies; a larger one is dealt out in pieces, which
are hashed in separate tasks and combined by an aggregate over a row for each piece. Documents with equal fingerprints
are then compared chunk by chunk: for each chunk number, the smallest and the largest chunk of the group must be the
same bytes. These are partial aggregates, so no group meets in one task. Should a fingerprint collide, its group is
divided by the texts' SHA-256.

Defined results: null counts as empty, and empty texts are equal. A row that repeats another, doc_id included, is a
copy of it, and one of them stays. A null doc_id sorts after the others. An empty table gives no rows. Other columns are
ignored, and kept by drop_copies, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, discard, in_bitmap, key_bitmap, prepare, scratch, semi, stored, texts_of, trimmed, unused

#: What normalisation deletes: space and 0x09 to 0x0D.
DELETED = bytes([0x20, *range(0x09, 0x0E)])
CHUNK = 1 << 16
#: Bytes of a normalised text above which its pieces are hashed in separate tasks; bytes of a piece, whole chunks.
HUGE, PIECE = 8 << 20, 1 << 20
#: Two primes under 2^31 and a base for each; bytes times powers, summed over a chunk, stay under 2^63.
PRIMES, BASES = (2147483647, 2147483629), (1_000_003, 16_777_619)


Hash = tuple[int, int, int]
_tables: dict[tuple[int, int], np.ndarray] = {}


def _powers(prime: int, base: int) -> np.ndarray:
    if (prime, base) not in _tables:
        out, last = np.empty(CHUNK, np.int64), 1
        for i in range(CHUNK):
            out[i] = last
            last = last * base % prime
        _tables[prime, base] = out
    return _tables[prime, base]


def chunk_hash(chunk: bytes, primes: tuple[int, int] = PRIMES) -> Hash:
    """(hash by the first prime, hash by the second, length) of at most CHUNK bytes."""
    x = np.frombuffer(chunk, np.uint8).astype(np.int64) + 1
    return (*(int(np.dot(x, _powers(p, b)[: len(x)])) % p for p, b in zip(primes, BASES, strict=True)), len(x))


def combine(a: Hash, b: Hash, primes: tuple[int, int] = PRIMES) -> Hash:
    """The hash of the bytes of a followed by those of b."""
    return (*((x + pow(base, a[2], p) * y) % p for x, y, p, base in zip(a, b, primes, BASES, strict=False)), a[2] + b[2])


def fingerprint(data: bytes, primes: tuple[int, int] = PRIMES) -> Hash:
    out = (0, 0, 0)
    for i in range(0, len(data), CHUNK):
        out = combine(out, chunk_hash(data[i : i + CHUNK], primes), primes) if i else chunk_hash(data[:CHUNK], primes)
    return out


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, DELETED)


def _first_pass(documents: DataFrame, huge: int, piece: int, primes: tuple[int, int]) -> DataFrame:
    """A row (row, doc_id, chars, h1, h2, size, sha) for each document, without hashes where the text is huge; rows (row, no, data) hold the pieces of those."""
    kind = "row long, doc_id long, chars long, h1 long, h2 long, size long, sha string, no long, data binary"
    out = arrow(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in parts:
            texts = texts_of(b.column(1))
            data = [normalised(t) for t in texts]
            h = [fingerprint(x, primes) if len(x) <= huge else (None, None, len(x)) for x in data]
            told = [range(row, row + len(data)), b.column(0).to_pylist(), list(map(len, texts)), *([x[i] for x in h] for i in range(3)), [hashlib.sha256(x).hexdigest() for x in data], [None] * len(data), [None] * len(data)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(told, out, strict=True)], schema=out)
            for i, x in enumerate(data):
                for at in range(0, len(x), piece) if len(x) > huge else ():
                    one = [row + i, None, None, None, None, None, None, at // piece, x[at : at + piece]]
                    yield pa.record_batch([pa.array([v], f.type) for v, f in zip(one, out, strict=True)], schema=out)
            row += len(data)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), kind)


def combined(pieces: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(row, h1, h2) from (row, no, data): pieces are dealt out, hashed apart, and combined in order. The aggregate holds a few numbers for each piece."""
    kind = "row long, no long, h1 long, s1 long, h2 long, s2 long"
    out = arrow(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            h = [fingerprint(x, primes) for x in b.column(2).to_pylist()]
            shift = lambda i: [pow(BASES[i], x[2], primes[i]) for x in h]  # noqa: B023, E731
            told = [[x[0] for x in h], shift(0), [x[1] for x in h], shift(1)]
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in told)], schema=out)

    hashed = pieces.select("row", "no", "data").repartition("row", "no").mapInArrow(trimmed(run), kind)

    def ordered(h: str, s: str, prime: int) -> Column:
        """Each piece's hash is shifted by the length of all before it: the shift is the product of theirs."""
        start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(1).cast("long").alias("s"))
        step = lambda a, x: F.struct(((a["h"] + a["s"] * x[h]) % prime).alias("h"), (a["s"] * x[s] % prime).alias("s"))
        return F.aggregate("p", start, step, lambda a: a["h"])

    rows = hashed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "h1", "s1", "h2", "s2"))).alias("p"))
    return rows.select("row", ordered("h1", "s1", primes[0]).alias("h1"), ordered("h2", "s2", primes[1]).alias("h2"))


def fingerprints(documents: DataFrame, huge: int = HUGE, piece: int = PIECE, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(row, doc_id, chars, h1, h2, size, sha) of each row, written: a number; code points of the text; fingerprint, size and SHA-256 of the normalised text."""
    first = stored(_first_pass(documents, huge, piece, primes), "fingerprints")
    pieces = first.where("data is not null")
    prints = first.where("data is null").drop("no", "data")
    if pieces.isEmpty():
        prints.stored_at = first.stored_at
        return prints
    late = combined(pieces, primes).select("row", F.col("h1").alias("late1"), F.col("h2").alias("late2"))
    columns = ["row", "doc_id", "chars", F.coalesce("h1", "late1").alias("h1"), F.coalesce("h2", "late2").alias("h2"), "size", "sha"]
    out = stored(prints.where("h1 is null").join(late, "row").select(*columns).unionByName(prints.where("h1 is not null")), "fingerprints")
    discard(first)
    return out


def _chunks(documents: DataFrame, primes: tuple[int, int]) -> DataFrame:
    kind = "h1 long, h2 long, size long, no long, chunk binary"
    out = arrow(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for t in texts_of(b.column(0)):
                x = normalised(t)
                h = fingerprint(x, primes)
                for no in range(max(1, -(-len(x) // CHUNK))):
                    yield pa.record_batch([*(pa.array([v], pa.int64()) for v in (*h, no)), pa.array([x[no * CHUNK : (no + 1) * CHUNK]], pa.binary())], schema=out)

    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), kind)


def collisions(documents: DataFrame, prints: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(h1, h2, size) of groups whose texts differ in some chunk. Rows without a doc_id are compared too, wherever they belong."""
    key = ["h1", "h2", "size"]
    # written first: a hot group's rows then meet a plain table, and the join can split them
    groups = stored(prints.where("size > 0").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "repeated")
    shared = prints.join(groups, key, "left_semi")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = semi(rows, shared, "doc_id").select("text").union(rows.where("doc_id is null").select("text"))
    out = stored(_chunks(again, primes).groupBy(*key, "no").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low <> high").select(*key).distinct(), "collisions")
    discard(groups)
    return out


def exact_groups(documents: DataFrame, huge: int = HUGE, piece: int = PIECE, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chars) of each row."""
    prepare(documents.sparkSession)
    key = ["h1", "h2", "size", "apart"]
    rows = prints = fingerprints(documents, huge, piece, primes)
    bad = collisions(documents, prints, primes)
    if bad.isEmpty():
        rows = rows.withColumn("apart", F.lit(""))
    else:
        rows = rows.join(bad.withColumn("bad", F.lit(True)), ["h1", "h2", "size"], "left").withColumn("apart", F.when(F.col("bad"), F.col("sha")).otherwise("")).drop("bad")
    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    groups = stored(rows.groupBy(*key).agg(best.alias("best"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    alone = F.col("group_size").isNull()
    return rows.join(groups, key, "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("chars").alias("n_chars"),
    )


def drop_copies(documents: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns. Only rows whose doc_id is dropped, repeated or null are shuffled."""
    with scratch() as keep:
        found = keep(stored(exact_groups(documents), "decisions"))
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("stay"))
    touched = ids.where("n > 1 or stay = 0 or doc_id is null").select("doc_id")
    maybe = in_bitmap(documents.sparkSession, key_bitmap(touched, "doc_id"), F.col("doc_id")) | F.col("doc_id").isNull()
    sha, size, told = (unused(documents, n) for n in ("text_sha256", "n_code_points", "told"))
    stay = found.where("kept").select(F.struct("doc_id", "text_sha256", F.col("n_chars").alias("size")).alias(told)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]", ""), 256)
    again = documents.where(maybe).withColumns({sha: own, size: F.char_length(text).cast("long")})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{told}.doc_id")) & (F.col(sha) == F.col(f"{told}.text_sha256")) & (F.col(size) == F.col(f"{told}.size"))
    again = again.join(stay, same, "left_semi").dropDuplicates(["doc_id", sha]).drop(sha, size)
    return documents.where(~maybe).unionByName(again)
