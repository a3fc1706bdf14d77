"""The life cycle of reset tokens as a stream: one live token a user, removed when it expires, and a mail for each that is issued.

A user's newest request, by created_at and then id, is the live one; a request replaces the token before it. State holds one
token and one timer a user, so it grows with the users that have a live token, not with the requests. Time is the watermark's:
a token goes once expires_at < watermark, and one that expires at that very moment stays. Requests no newer than the watermark are
left out, as the stream can't tell any more what they replace.

Changes go to a log and mails to an outbox, a folder for each micro-batch. A batch that is replayed after a failure adds
nothing: a folder that was finished isn't written again, an unfinished one is overwritten, and readers take finished ones only.

Only a user's newest request of a batch matters, so rows are dealt by user and cut to the newest before they reach the state:
Python sees rows one by one there, and has a row for each user and batch, not for each request.

Defined results: requests without user, id, time or expiry are left out. Repeated requests change nothing. A token that has expired when
its request arrives still replaces the one before. A null token is one. Mails go to known users only; of several rows of one user the
smallest address and name count. Columns of requests other than the five named are ignored. An empty stream gives an empty log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from brightloom.operators import snapshot
from brightloom.session import shipped

#: Rows that a task holds while it looks for the newest of each user.
HELD = 1 << 18
CHANGES = "user_id long, id long, token string, expires_us long, change int"
MAILS = "user_id long, id long, address string, name string, token string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OneToken(StatefulProcessor):
    """Keyed by user: the live token and the timer of its expiry. Gives changes, 1 for a token issued and -1 for one removed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "created_us long, id long, token string, expires_us long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = tuple(self.live.get()) if self.live.exists() else None
        new = old
        for r in rows:
            if new is None or (r.created_us, r.id) > new[:2]:
                new = (r.created_us, r.id, r.token, r.expires_us)
        if new == old:
            return
        if old is not None:
            self.handle.deleteTimer(old[3] // 1000 + 1)
            yield _change(key, old, -1)
        if new[3] // 1000 < timerValues.getCurrentWatermarkInMs():
            self.live.clear()
        else:
            self.live.update(new)
            # timers fire once the watermark reaches them
            self.handle.registerTimer(new[3] // 1000 + 1)
            yield _change(key, new, 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        old = tuple(self.live.get()) if self.live.exists() else None
        if old is not None and old[3] // 1000 < timerValues.getCurrentWatermarkInMs():
            self.live.clear()
            yield _change(key, old, -1)

    def close(self) -> None:
        pass


def _change(key: Any, token: tuple, change: int) -> Row:
    return Row(user_id=key[0], id=token[1], token=token[2], expires_us=token[3], change=change)


def newest(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: of each user's rows (user_id, created_at, id, ...) the newest. So many rows are held at most, and a batch; a task with
    more users than half of that gives some users several rows."""
    kept: list[pa.RecordBatch] = []
    rows = 0

    def cut() -> pa.Table:
        table = pa.Table.from_batches(kept)
        table = table.take(pc.sort_indices(table, [("user_id", "ascending"), ("created_at", "descending"), ("id", "descending")])).combine_chunks()
        users = table.column("user_id").to_numpy()
        first = pa.array([True] * min(1, len(users)) + (users[1:] != users[:-1]).tolist(), pa.bool_())
        return table.filter(first)

    for b in batches:
        kept.append(b)
        rows += b.num_rows
        if rows > held:
            table = cut()
            kept, rows = table.to_batches(), table.num_rows
            if rows > held // 2:
                yield from kept
                kept, rows = [], 0
    if rows:
        yield from cut().to_batches()


def _asked(requests: DataFrame) -> DataFrame:
    at = {c: F.col(c).cast("timestamp") for c in ("created_at", "expires_at")}
    some = requests.select(F.col("user_id").cast("long").alias("user_id"), F.col("id").cast("long").alias("id"), F.col("token").cast("string").alias("token"), *(v.alias(k) for k, v in at.items()))
    return some.na.drop(subset=["user_id", "id", "created_at", "expires_at"])


def token_changes(requests: DataFrame, late: str = "0 seconds") -> DataFrame:
    """CHANGES of a stream of requests (user_id, id, token, created_at, expires_at); those over `late` behind the newest are left out."""
    rows = _asked(requests).withColumns({"created_us": F.unix_micros("created_at"), "expires_us": F.unix_micros("expires_at")}).drop("expires_at")
    rows = shipped(rows).repartition("user_id").mapInArrow(newest, rows.schema)
    return rows.withWatermark("created_at", late).groupBy("user_id").transformWithState(OneToken(), CHANGES, "Update", "EventTime")


def live_tokens(changes: DataFrame) -> DataFrame:
    """(user_id, id, token): what a log leaves, one row a user at most."""
    return changes.groupBy("user_id", "id", "token").agg(F.sum("change").alias("n")).where("n > 0").select("user_id", "id", "token")


def live_tokens_at(requests: DataFrame, as_of: str) -> DataFrame:
    """The same from a table of all requests, for a watermark: each user's newest, without those that have expired."""
    rows = _asked(requests)
    last = snapshot.replace_by(rows.limit(0), rows.withColumn("_by", F.struct("created_at", "id")), "user_id", "_by")
    # expiry is told in whole milliseconds, as the watermark is
    return snapshot.delete(last, F.date_trunc("millisecond", "expires_at") < F.lit(as_of).cast("timestamp")).select("user_id", "id", "token")


def mails(changes: DataFrame, users: DataFrame) -> DataFrame:
    """MAILS for the tokens issued; users are (user_id, address, name)."""
    to = users.groupBy("user_id").agg(F.min(F.struct("address", "name")).alias("to"))
    return changes.where("change = 1").join(to, "user_id").select("user_id", "id", "to.address", "to.name", "token")


# ---- Sinks that take each batch once ----------------------------------------------------------------


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_once(rows: DataFrame, root: str, batch: int) -> str:
    """Writes the folder of a batch unless that was finished before; returns its path."""
    folder = f"{root}/batch={batch}"
    mark, fs = _path(rows.sparkSession, f"{folder}/_SUCCESS")
    if not fs.exists(mark):
        rows.write.mode("overwrite").parquet(folder)
    return folder


def read_finished(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of all finished batches."""
    marks, fs = _path(spark, f"{root}/batch=*/_SUCCESS")
    folders = [str(s.getPath().getParent().toString()) for s in (fs.globStatus(marks) or [])]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def sink(users: DataFrame, root: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the changes go to root/log, and mails for what the log then holds of this batch to root/outbox."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        logged = spark.read.schema(CHANGES).parquet(write_once(batch, f"{root}/log", number))
        write_once(mails(logged, users), f"{root}/outbox", number)

    return write


def start(requests: DataFrame, users: DataFrame, root: str, late: str = "0 seconds", **trigger: Any) -> StreamingQuery:
    """Runs the life cycle; its checkpoint, log and outbox lie below root. State with timers needs the RocksDB store, which the
    session keeps from then on."""
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream = token_changes(requests, late).writeStream.foreachBatch(sink(users, root)).outputMode("update")
    return stream.option("checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
