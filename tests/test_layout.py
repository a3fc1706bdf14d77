import os

import pytest
from pyspark.sql import functions as F

from brightloom.operators import snapshot
from brightloom.sources import layout


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_joins_of_indexed_tables_have_no_exchange(spark, data, no_broadcast):
    customers = spark.read.parquet(f"{data}/customer.parquet")
    orders = spark.read.parquet(f"{data}/orders.parquet").unionByName(spark.createDataFrame([(None, -1)], "o_custkey long, o_orderkey long"), allowMissingColumns=True)
    layout.write_indexed(customers, "ix_customers", ["c_custkey"], 4)
    layout.write_indexed(orders, "ix_orders", ["o_custkey"], 4)
    try:
        joined = spark.table("ix_orders").join(spark.table("ix_customers"), F.col("o_custkey") == F.col("c_custkey"), "left")
        counts = joined.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("c_name").alias("c_name"))
        assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
        plain = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("c_name").alias("c_name"))
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        assert set(map(tuple, counts.collect())) == set(map(tuple, plain.collect()))
    finally:
        spark.sql("drop table ix_customers")
        spark.sql("drop table ix_orders")


def test_lookups_read_only_groups_that_may_hold_the_value(spark):
    df = spark.range(40000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("token_hash"), F.concat(F.lit("User"), F.col("id"), F.sha2(F.col("id").cast("string"), 224)).alias("email"))
    layout.write_indexed(df, "ix_tokens", ["id"], 1, bloom=("token_hash",), folded=("email",))
    layout.write_indexed(df, "ix_plain", ["id"], 1)
    try:
        t, absent = spark.table("ix_tokens"), "8" * 64
        assert rows_read(layout.found(spark.table("ix_plain"), "token_hash", absent)) == 40000
        assert rows_read(layout.found(t, "token_hash", absent)) == 0
        there = df.where("id = 77").first()
        assert [r["id"] for r in layout.found(t, "token_hash", there["token_hash"]).collect()] == [77]
        assert [r["id"] for r in layout.found(t, "email", there["email"].upper(), folded=True).collect()] == [77]
        assert rows_read(layout.found(t, "email", "User5x", folded=True)) == 0
        with pytest.raises(ValueError, match="email_folded"):
            layout.write_indexed(df.withColumn("Email_Folded", F.lit(1)), "ix_no", ["id"], 1, folded=("email",))
    finally:
        spark.sql("drop table ix_tokens")
        spark.sql("drop table ix_plain")


def files(path):
    return {b: sorted(f for f in os.listdir(path / b) if f.endswith(".parquet")) for b in os.listdir(path) if b.startswith(layout.BUCKET)}


def test_writes_leave_other_buckets_alone(spark, tmp_path):
    path, key = tmp_path / "t", "id"
    old = spark.createDataFrame([*((i, f"n{i}", 0) for i in range(200)), (None, "none", 0), (7, "again", 1)], "id long, name string, likes int")
    layout.write_buckets(old, str(path), key, 16)
    before = files(path)
    assert len(before) == 16

    # keys of another type, repeated ones and one that isn't there
    changes = spark.createDataFrame([(7, "x", ["name"]), (7, "y", ["name"]), (999, "z", ["name"])], "id int, name string, fields_set array<string>")
    touched = layout.change_buckets(spark, str(path), key, 16, changes, lambda t: snapshot.patch(t, changes, key, ["name"]))
    after, names = files(path), {f"{layout.BUCKET}={b}" for b in touched}
    assert 1 <= len(touched) <= 2 and all((before[b] == after[b]) == (b not in names) for b in before)
    want = sorted(snapshot.patch(old, changes, key, ["name"]).collect(), key=str)
    assert sorted(layout.read_buckets(spark, str(path)).select(old.columns).collect(), key=str) == want

    # all rows of a bucket go, and the null key stays
    gone = spark.read.parquet(str(path)).where(f"{layout.BUCKET} = {touched[0]} and id is not null").select(key)
    ids = [r[0] for r in gone.collect()]
    layout.change_buckets(spark, str(path), key, 16, gone, lambda t: snapshot.delete(t, F.col("id").isin(ids)))
    assert sorted(layout.read_buckets(spark, str(path)).select(old.columns).collect(), key=str) == [r for r in want if r["id"] not in ids]

    kept = files(path)
    assert layout.change_buckets(spark, str(path), key, 16, changes.limit(0), lambda t: t) == [] and files(path) == kept
    with pytest.raises(ValueError, match="buckets"):
        one = layout.read_buckets(spark, str(path)).where("id = 150")
        layout.change_buckets(spark, str(path), key, 16, one, lambda t: t.unionByName(old.where("id < 20")))
    assert files(path) == kept
    with pytest.raises(ValueError, match=layout.BUCKET):
        layout.write_buckets(old.withColumn(layout.BUCKET, F.lit(1)), str(tmp_path / "no"), key, 4)
