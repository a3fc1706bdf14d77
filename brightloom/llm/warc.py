"""Deterministic sharded WARC writer and reader.

Records are sorted over ranges of page_id. The ranges' bounds are exact: bytes are added up along the sorted page_ids and
cut into equal parts, so they depend on the rows alone, not on partitions or on samples, and repeated writes of a table
give the same files and the same manifest. Each task writes its range to files that roll once their compressed size
passes a limit. Every record's headers are generated anew, with block and payload digests and a record id derived from
them; each record is one gzip member without a time stamp, so a repeated task writes the same bytes. A file is written
under a temporary name and renamed when it is closed; a task returns a manifest line for each file; the driver commits
by renaming the manifest and removes what failed attempts left. Readers open only files that the manifest lists, and
check sizes and digests.

Files go through pyarrow's file systems, so the folder may be in any store that these reach. A folder without a scheme lies in
Hadoop's default file system, as elsewhere in Spark.

Defined results: a null html is an empty payload. Of equal payloads of at least MIN_REVISIT bytes the record with the
smallest page_id is the response, the others revisit it; smaller ones are all responses. Rows that repeat a page_id are
records of their own, of which one is the response; they share a range. A null page_id sorts last, in a range of its
own. In WARC-Target-URI control characters and spaces are percent-encoded (`http://a/ b` comes back as `http://a/%20b`); a
null url is an empty one. An empty table makes an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, discard, prepare, shared_folder, stored, trimmed, whole

#: Compressed bytes after which a file is closed, and the smallest payload that can be revisited.
ROLL_BYTES, MIN_REVISIT = 64 << 20, 0
#: Payload bytes of a range: the lesser where there are FEW ranges at most, the greater beyond. Bytes that headers count.
LEAST_RANGE, FEW, RANGE, HEADERS = 8 << 20, 64, 1 << 30, 600
#: Records carry this time, as pages have none.
DATE = "2000-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_END = b"\r\n"


def digest(data: bytes) -> str:
    """Base32 SHA-1, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, row: int, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{row}/{payload_digest}')}>"


def record(page_id: int | None, row: int, url: str | None, payload: bytes, refers_to: int | None, response: bool) -> bytes:
    """A response with its payload or a revisit without, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if response else b"")
    payload_digest = digest(payload)
    uri = "".join(f"%{ord(c):02X}" if c < "!" else c for c in (url or ""))
    head = {
        "WARC-Type": "response" if response else "revisit",
        "WARC-Record-ID": record_id(page_id, row, payload_digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if not response:
        head |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": record_id(refers_to, 0, payload_digest),
            "WARC-Refers-To-Date": DATE,
            "X-Refers-To-Page-ID": "" if refers_to is None else str(refers_to),
        }
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + _END + block + _END + _END


def parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            k, _, v = line.decode().partition(":")
            head[k] = v.strip()
        block = stream.read(int(head["Content-Length"]))
        if head.get("WARC-Block-Digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
            raise ValueError(f"block digest of {head.get('WARC-Record-ID')} differs")
        yield head, block


class Writer:
    """Files of one task. A closed file gets its name by one rename."""

    def __init__(self, folder: str, shard: int, attempt: str, roll: int = ROLL_BYTES):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.shard, self.attempt, self.roll, self.number, self.out = shard, attempt, roll, 0, None
        self.lines: list[dict] = []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary-{self.name}-{self.attempt}"
            self.out, self.sha, self.size, self.records = self.files.open_output_stream(self.temporary), hashlib.sha256(), 0, 0
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.move(self.temporary, f"{self.root}/{self.name}")
            self.lines.append({"file": self.name, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()})
            self.number, self.out = self.number + 1, None


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as pyarrow's file systems name it. One without a scheme lies in Hadoop's default file system, as it does
    for Spark; s3a and s3n are s3."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    uri = hadoop.Path(folder).toUri()
    at = uri if uri.getScheme() else hadoop.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration())
    scheme = {"s3a": "s3", "s3n": "s3"}.get(at.getScheme(), at.getScheme())
    return f"{scheme}://{at.getRawAuthority() or ''}{uri.getPath()}"


def range_bounds(sizes: DataFrame, shards: int | None = None) -> list[int]:
    """The largest page_id of each range, from distinct rows (page_id, bytes) without nulls."""
    spark = sizes.sparkSession
    rows = whole(sizes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id").sortWithinPartitions("page_id"))
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33).cast("int"))
    held = rows.groupBy("part").agg(F.sum("bytes").alias("bytes")).orderBy("part").collect()  # a row for each partition
    total, starts = 0, []
    for r in held:
        starts.append((r["part"], total))
        total += r["bytes"]
    if not total:
        return []
    count = shards or max(-(-total // RANGE), min(FEW, -(-total // LEAST_RANGE)))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(F.broadcast(spark.createDataFrame(starts, "part int, ahead long")), "part").select("page_id", (F.col("ahead") + before).alias("before"))
    shard = F.floor(F.col("before").cast("decimal(38,0)") * count / total).cast("long")
    return sorted(r["last"] for r in placed.groupBy(shard.alias("shard")).agg(F.max("page_id").alias("last")).collect())  # a row for each range


def write_warc(pages: DataFrame, folder: str, shards: int | None = None, roll: int = ROLL_BYTES) -> list[dict]:
    """Writes a record for each page and commits; the manifest's lines, sorted by file. shards: ranges, nearly; without, by the bytes."""
    spark = prepare(pages.sparkSession)
    folder = qualified(spark, folder)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    # Equality of payloads is that of SHA-256 and length; rows get numbers so that repeated rows are told apart.
    sums = stored(base.select("page_id", F.sha2("html", 256).alias("sha"), F.octet_length("html").cast("long").alias("size"), F.monotonically_increasing_id().alias("row")), "payloads")
    first = sums.where(f"size >= {MIN_REVISIT}").groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("page_id"), F.col("row").alias("row"))).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first, "firsts")  # a plain table: the join can split the rows of a frequent payload
    again = sums.join(first, "sha").where("row <> first.row").groupBy("page_id", "sha").agg(F.first("first.page_id").alias("refers_to"))
    bounds = range_bounds(sums.where("page_id is not null").groupBy("page_id").agg(F.sum(F.col("size") + HEADERS).alias("bytes")), shards)
    held = spark.sparkContext.broadcast(np.array(bounds[:-1], np.int64))

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(held.value, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(held.value) + 1, at).astype(np.int32))

    # What is known of a page's payload sorts right before its rows, so they meet in the range and payloads aren't joined.
    notes = again.select("page_id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to")
    rows = base.select("page_id", F.sha2("html", 256).alias("sha"), F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    dealt = notes.union(rows).withColumn("range", range_of("page_id")).repartitionById(len(bounds) + 1, "range")
    dealt = dealt.sortWithinPartitions("range", F.col("page_id").asc_nulls_last(), "sha", "kind", "url")
    kind = "file string, records long, bytes long, sha256 string"
    out = arrow(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = str(TaskContext.get().taskAttemptId())
        to, lines = None, []
        last, nth, note = None, 0, (False, None)
        for b in parts:
            for page, sha, is_row, url, text, refers_to, shard in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if to is None or to.shard != shard:
                    if to:
                        to.close()
                    to = Writer(folder, shard, attempt, roll)
                    lines.append(to.lines)
                if (page, sha) != last:
                    last, nth, note = (page, sha), 0, (False, None)
                if not is_row:
                    note = (True, refers_to)
                    continue
                # of rows that repeat a page, the first one is the response unless an earlier page has the payload
                response = not note[0] or nth == 0 and note[1] == page
                to.add(record(page, nth, url, text.encode("utf-8", "surrogatepass"), note[1], response))
                nth += 1
        if to:
            to.close()
        told = [x for some in lines for x in some]
        yield pa.record_batch([pa.array([x[f.name] for x in told], f.type) for f in out], schema=out)

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root)
    lines = sorted((r.asDict() for r in dealt.mapInArrow(trimmed(run), kind).collect()), key=lambda x: x["file"])  # one line for each file
    discard(sums, first)
    with files.open_output_stream(f"{root}/_temporary-manifest") as f:
        f.write(json.dumps({"format": "WARC/1.1", "files": lines}, indent=1).encode())
    files.move(f"{root}/_temporary-manifest", f"{root}/manifest.json")
    for x in files.get_file_info(fs.FileSelector(root)):
        if x.base_name.startswith("_temporary-"):
            files.delete_file(x.path)
    return lines


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record that the manifest lists."""
    folder = qualified(prepare(spark), folder)
    files, root = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        lines = json.loads(f.read())["files"]
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    out = arrow(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        for b in parts:
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = f"{root}/{name}"
                if files.get_file_info(path).size != size:
                    raise ValueError(f"{path} hasn't the {size} bytes of the manifest")
                with files.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    rows = []
                    for head, block in parsed(plain):
                        number = lambda k, head=head: int(head[k]) if head.get(k) else None
                        payload = block.partition(b"\r\n\r\n")[2]
                        told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and (digest(payload) != told or len(payload) != number("X-Payload-Length")):
                            raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
                        rows.append((number("X-Page-ID"), head["WARC-Target-URI"], number("X-Payload-Length"), told, head["WARC-Type"], number("X-Refers-To-Page-ID")))
                        if len(rows) == 1000:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                            rows = []
                    if rows:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    listed = spark.createDataFrame([(x["file"], x["bytes"]) for x in lines], "file string, bytes long")
    return listed.repartition(max(1, len(lines))).mapInArrow(trimmed(run), kind)


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages to a new folder, reads the archives back."""
    spark = prepare(pages.sparkSession)
    folder = folder or shared_folder(spark, "warc")
    write_warc(pages, folder)
    return read_warc(spark, folder)
