import random

import pyarrow as pa

from brightloom.streaming import tokens

SCHEMA = pa.schema([("user_id", pa.int64()), ("created_at", pa.timestamp("us", "UTC")), ("id", pa.int64()), ("token", pa.string())])


def batches(rows, size):
    return [pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows[i : i + size]], SCHEMA) for i in range(0, len(rows), size)]


def best(rows):
    out = {}
    for r in rows:
        out[r[0]] = max(out.get(r[0], r), r)
    return sorted(out.values())


def read(parts):
    return [(r["user_id"], r["created_at"].timestamp() * 1e6, r["id"], r["token"]) for b in parts for r in b.to_pylist()]


def test_one_row_a_user_reaches_the_state():
    draw = random.Random(5)
    rows = [(draw.randrange(30), draw.randrange(50), i % 40, f"t{i % 40}") for i in range(3000)]
    rows += rows[:10]
    for size, held in ((7, 100), (1000, 100), (1000, 1 << 18)):
        assert sorted(read(tokens.newest(iter(batches(rows, size)), held))) == best(rows)
    # more users than a task may hold: some have several rows, the newest among them, and no more is held
    many = sorted(read(tokens.newest(iter(batches(rows, 7)), 20)))
    assert set(best(rows)) <= set(many) <= set(rows) and best(many) == best(rows)
    assert list(tokens.newest(iter([]))) == [] == list(tokens.newest(iter(batches(rows, 7)[:1][0:0])))
