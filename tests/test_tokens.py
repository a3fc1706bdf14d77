import datetime

import pytest

from brightloom.streaming import tokens

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "user_id long, id long, token string, created_at timestamp, expires_at timestamp, batch string"


def at(minutes, micros=0):
    return DAY + datetime.timedelta(minutes=minutes, microseconds=micros)


def asked(user, number, created, lives=30, micros=0):
    return (user, number, f"t{number}", at(created), at(created + lives, micros), "extra")


BATCHES = [
    [asked(1, 1, 0), asked(1, 2, 5), asked(2, 3, 5), asked(1, 2, 5), (None, 4, "x", at(1), at(9), None), (3, 5, "x", None, at(9), None), (3, None, "x", at(1), at(9), None)],
    [asked(2, 6, 20), asked(3, 7, 20), asked(3, 8, 19), asked(4, 9, 20, 15)],
    [],
    # the watermark comes to minute 35: 2 and 9 expire then, and so stay
    [asked(5, 10, 35)],
    [asked(5, 11, 36, -10), asked(6, 12, 36)],
    [asked(6, 13, 90), asked(7, 14, 10)],
]


def batch_result(spark, n, wm):
    rows = [r for b in BATCHES[:n] for r in b if r[1] != 14]
    return sorted(map(tuple, tokens.live_tokens_at(spark.createDataFrame(rows, SCHEMA), str(at(wm))).collect()))


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(i, f"u{i}@example.org", f"u{i}") for i in (1, 2, 3, 4, 5, 6)] + [(1, "z@example.org", "z")], "user_id long, address string, name string")


def test_the_stream_equals_the_batch_queries_after_each_batch_and_restart(spark, users, tmp_path):
    root, source = f"file://{tmp_path}/out", str(tmp_path / "in")
    live = lambda: sorted(map(tuple, tokens.live_tokens(tokens.read_finished(spark, f"{root}/log", tokens.CHANGES)).collect()))
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    seen = []
    # each batch is a query of its own that starts again from the checkpoint
    for n, rows in enumerate(BATCHES, 1):
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        tokens.start(spark.readStream.schema(SCHEMA).parquet(source), users, root).awaitTermination()
        wm = max((r[3] for b in BATCHES[:n] for r in b if r[3] is not None and None not in r[:2]))
        want = batch_result(spark, n, (wm - DAY).total_seconds() / 60)
        assert live() == want, n
        seen.append(want)
    assert seen[0] == [(1, 2, "t2"), (2, 3, "t3")]
    assert seen[1] == [(1, 2, "t2"), (2, 6, "t6"), (3, 7, "t7"), (4, 9, "t9")] == seen[2]
    assert seen[3] == [(1, 2, "t2"), (2, 6, "t6"), (3, 7, "t7"), (4, 9, "t9"), (5, 10, "t10")]
    # the request of user 5 that was expired on arrival took the token before it away
    assert seen[4] == [(2, 6, "t6"), (3, 7, "t7"), (6, 12, "t12")]
    assert seen[5] == [(6, 13, "t13")]
    sent = sorted((r["id"], r["address"]) for r in tokens.read_finished(spark, f"{root}/outbox", tokens.MAILS).collect())
    assert sent == [(2, "u1@example.org"), (3, "u2@example.org"), (6, "u2@example.org"), (7, "u3@example.org"), (9, "u4@example.org"), (10, "u5@example.org"), (12, "u6@example.org"), (13, "u6@example.org")]


def test_a_replayed_batch_adds_no_row(spark, users, tmp_path):
    root = f"file://{tmp_path}"
    changes = spark.createDataFrame([(1, 1, "a", 9, 1), (2, 2, None, 9, 1), (3, 3, "c", 9, -1), (9, 4, "d", 9, 1)], tokens.CHANGES)
    write = tokens.sink(users, root)
    for number in (0, 1, 0, 1):
        write(changes.where(f"id % 2 = {number}"), number)
    read = lambda name, schema: tokens.read_finished(spark, f"{root}/{name}", schema)
    assert read("log", tokens.CHANGES).count() == 4
    assert sorted(map(tuple, read("outbox", tokens.MAILS).collect())) == [(1, 1, "u1@example.org", "u1", "a"), (2, 2, "u2@example.org", "u2", None)]
    # a batch that was cut off isn't read, and is written again
    (tmp_path / "outbox" / "batch=1" / "_SUCCESS").unlink()
    assert read("outbox", tokens.MAILS).count() == 1
    write(changes.where("id % 2 = 1"), 1)
    assert read("outbox", tokens.MAILS).count() == 2


def test_empty_logs(spark, tmp_path):
    assert tokens.live_tokens(tokens.read_finished(spark, f"file://{tmp_path}/none", tokens.CHANGES)).count() == 0
    assert tokens.live_tokens_at(spark.createDataFrame([], SCHEMA), str(DAY)).count() == 0
