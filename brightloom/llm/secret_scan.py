"""Incremental secret scans with a blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger has two tables: `versions`, a row
(path, scan, blob) for each text that a path ever had, with the number of the scan that first saw it, and `findings`, a row for
each blob and rule version that was scanned. A scan takes only pairs that the ledger lacks, appends them, and joins
findings back to the rows; `history` joins them back to all paths and all their versions. A copy is scanned once, an
unchanged corpus not at all, and a new rule version rescans every blob that is still there once.

Texts are scanned where they lie wherever a bitmap shows that no other row and no earlier scan has the blob. Of the others
only the rows chosen to be scanned are shuffled.

Base findings come from fixed patterns. The ledger's rules may add kinds of their own; base findings stay.

Defined results: null counts as empty; an empty text has no findings. Rows that repeat share a blob, and a version. A null doc_id
stays, and is a path of its own. A kind without matches counts 0. An empty table gives no rows. Other columns are ignored. Two scans at a time may
write a finding or a version twice; each is taken once when it is read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, discard, in_bitmap, key_bitmap, prepare, shared_folder, stored, texts_of, trimmed

#: Fixed patterns, and the least length of group 2, of the match, of the match. Case counts for ASCII letters only.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Kinds that the method adds; spans of base kinds come first in the order.
ADDED = {
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    "entropy": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_-])"),
}
KINDS = ("assign", "access", "hex", *ADDED)
RULES = "2"


def _entropy(text: str) -> float:
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of all findings, sorted; places are code points, ends exclusive."""
    out = []
    low = text.lower()
    if any(x in low for x in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), 3, m.end()) for m in ADDED["jwt"].finditer(text)]
    if "PRIVATE KEY" in text:
        out += [(m.start(), 4, m.end()) for m in ADDED["pem"].finditer(text)]
    out += [(m.start(), 5, m.end()) for m in ADDED["entropy"].finditer(text) if any(c.isdigit() for c in m[0]) and _entropy(m[0]) >= 4.2]
    return sorted(out)


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


FINDINGS = "blob string, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
VERSIONS = "doc_id long, scan int, blob string"


def findings(texts: DataFrame, rules: str) -> DataFrame:
    """Ledger rows for (blob, text)."""
    out = arrow(FINDINGS)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for blob, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                all_of = spans(text)
                base = [x for x in all_of if x[1] < 3]
                n = Counter(k for _, k, _ in base)
                rows.append((blob, rules, n[0], n[1], n[2], hashlib.sha256(told(base).encode()).hexdigest(), told(all_of)))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out) if rows else pa.record_batch([pa.array([], f.type) for f in out], schema=out)

    return texts.select("blob", "text").mapInArrow(trimmed(run), FINDINGS)


def ledger_rows(spark: SparkSession, ledger: str, name: str) -> DataFrame:
    """A table of the ledger; empty if nothing was scanned yet."""
    kind = {"findings": FINDINGS, "versions": VERSIONS}[name]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(f"{ledger}/{name}")


def _known(spark: SparkSession, ledger: str, rules: str) -> DataFrame:
    return ledger_rows(spark, ledger, "findings").where(F.col("rules") == rules)


def _per_blob(found: DataFrame) -> DataFrame:
    """One row for each blob, written, so that the rows of a frequent blob meet a plain table."""
    return stored(found.drop("rules").dropDuplicates(["blob"]), "findings")


def record(documents: DataFrame, ledger: str, rules: str = RULES) -> DataFrame:
    """Scans what the ledger lacks and appends it; the rows' (doc_id, blob), written."""
    spark = prepare(documents.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    versions = stored(rows.select("doc_id", F.sha2("text", 256).alias("blob")), "versions")
    blobs = versions.groupBy("blob").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("doc_id"), F.count("*").alias("n"))
    seen = _known(spark, ledger, rules).select("blob").distinct().withColumn("seen", F.lit(True))
    blobs = stored(blobs.join(seen, "blob", "left").select("blob", "doc_id", "n", F.coalesce("seen", F.lit(False)).alias("seen")), "blobs")
    if not blobs.where("not seen").isEmpty():
        _unseen(rows, blobs, rules).write.mode("append").parquet(f"{ledger}/findings")
    _add_versions(versions, ledger)
    discard(blobs)
    return versions


def scan(documents: DataFrame, ledger: str | None = None, rules: str = RULES) -> DataFrame:
    """(doc_id, blob, n_assign, n_access, n_hex, base_sha256, spans) of each row. ledger: a folder that stays between scans."""
    spark = prepare(documents.sparkSession)
    ledger = ledger or shared_folder(spark, "ledger")
    versions = record(documents, ledger, rules)
    return versions.join(_per_blob(_known(spark, ledger, rules)), "blob").select("doc_id", "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def _add_versions(versions: DataFrame, ledger: str) -> None:
    """Appends the (path, blob) pairs that the ledger lacks, under the next scan's number."""
    spark = versions.sparkSession
    held = ledger_rows(spark, ledger, "versions")
    number = held.agg(F.coalesce(F.max("scan"), F.lit(0)).alias("n")).first()["n"] + 1
    pairs = versions.distinct()
    if number > 1:
        old = held.select(F.col("doc_id").alias("_id"), F.col("blob").alias("_blob")).distinct()
        pairs = pairs.join(old, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("blob") == F.col("_blob")), "left_anti")
    pairs.select("doc_id", F.lit(number).alias("scan"), "blob").write.mode("append").parquet(f"{ledger}/versions")


def _unseen(rows: DataFrame, blobs: DataFrame, rules: str) -> DataFrame:
    """Findings of each unseen blob, once. Rows whose blob is surely neither repeated nor seen are scanned in place. Of the
    others the row with an unseen blob's smallest doc_id is scanned; rows that repeat that doc_id have the blob only if their hash says so."""
    spark = rows.sparkSession
    repeated = lambda: F.xxhash64(F.lit("repeated or seen"), "blob")
    chosen = lambda doc_id: F.xxhash64(F.lit("chosen"), doc_id, "blob")
    pick = blobs.where("not seen").select(F.col("doc_id").alias("_id"), F.col("blob").alias("_blob"))
    keys = F.array_compact(F.array(F.when(F.col("seen") | (F.col("n") > 1), repeated()), F.when(~F.col("seen"), chosen("doc_id"))))
    bitmap = key_bitmap(blobs.select(F.explode(keys).alias("key")), "key")  # one bitmap has both kinds of keys
    rows = rows.withColumns({"blob": F.sha2("text", 256), "_d": F.coalesce("doc_id", F.lit(0))})
    maybe, picked = in_bitmap(spark, bitmap, repeated()), in_bitmap(spark, bitmap, chosen("_d"))
    again = rows.where(maybe & picked).join(pick.hint("merge"), (F.col("_d") == F.col("_id")) & (F.col("blob") == F.col("_blob")), "left_semi")
    return findings(rows.where(~maybe).select("blob", "text").union(again.select("blob", "text").dropDuplicates(["blob"])), rules)


def history(spark: SparkSession, ledger: str, rules: str = RULES) -> DataFrame:
    """(doc_id, scan, blob, n_assign, n_access, n_hex, base_sha256, spans): the findings of every version that any path ever had.
    Blobs that weren't scanned by these rules, as they had gone before, have null findings."""
    prepare(spark)
    versions = ledger_rows(spark, ledger, "versions").groupBy("doc_id", "blob").agg(F.min("scan").alias("scan"))
    return versions.join(_per_blob(_known(spark, ledger, rules)), "blob", "left").select("doc_id", "scan", "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
