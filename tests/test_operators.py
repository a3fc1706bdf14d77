import base64
import datetime
import hashlib
import hmac
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightloom.functions import scalar
from brightloom.operators import learning, metrics, nearest, paging, ranking, retrieval, series, snapshot, validation
from brightloom.sources import tables


def part(x: bytes) -> str:
    return base64.urlsafe_b64encode(x).decode().rstrip("=")


def test_jwt_is_that_of_the_standard_library(spark):
    key = b"k" * 70
    row = spark.range(1).select(scalar.jwt(F.lit(5), F.lit(99), key).alias("t"), scalar.jwt_subject(scalar.jwt(F.lit(5), F.lit(99), key), key, F.lit(98)).alias("ok"), scalar.jwt_subject(scalar.jwt(F.lit(5), F.lit(99), key), key, F.lit(99)).alias("late"), scalar.jwt_subject(F.lit("a.b"), key, F.lit(0)).alias("bad")).first()
    signed = part(b'{"alg":"HS256","typ":"JWT"}') + "." + part(json.dumps({"sub": "5", "exp": 99}, separators=(",", ":")).encode())
    assert row["t"] == signed + "." + part(hmac.new(key, signed.encode(), hashlib.sha256).digest())
    assert (row["ok"], row["late"], row["bad"]) == ("5", None, None)


def test_pages_join_up(spark):
    rows = spark.range(44).select("id", (F.col("id") % 5).alias("t"))
    order = [F.desc("t"), F.desc("id")]
    pages = [[r["id"] for r in paging.page(rows, order, 10 * i, 10).collect()] for i in range(5)]
    assert [len(p) for p in pages] == [10, 10, 10, 10, 4]
    assert sum(pages, []) == [r["id"] for r in rows.orderBy(*order).collect()]
    assert [paging.envelope(rows, 10 * i, 10).first()["has_more"] for i in range(5)] == [True] * 4 + [False]
    with pytest.raises(ValueError):
        paging.page(rows, order, 0, 101)


def test_ranks_are_gapless(spark):
    got = ranking.ranked(spark.range(1000), F.floor(F.col("id") / 37), [F.col("id")]).orderBy("id").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))


def test_delete_then_insert_is_identity(spark):
    old = spark.range(10).select("id", F.col("id").cast("string").alias("v"))
    gone = old.where("id = 3")
    assert sorted(snapshot.insert(snapshot.delete(old, F.col("id") == 3), gone).collect()) == sorted(old.collect())


def test_patch_tells_null_from_unset(spark):
    old = spark.createDataFrame([(1, "a", "b")], "id int, x string, y string")
    change = spark.createDataFrame([(1, None, None, ["x"])], "id int, x string, y string, fields_set array<string>")
    assert snapshot.patch(old, change, "id", ["x", "y"]).collect() == [(1, None, "b")]


def test_metrics_by_hand(spark):
    rows = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2)]
    df = spark.createDataFrame(rows, "y_true int, y_pred int")
    assert sum(r["n"] for r in metrics.confusion(df).collect()) == len(rows)
    w = metrics.weighted_prf(df).first()
    assert w["recall"] == pytest.approx(metrics.accuracy(df).first()["accuracy"]) == pytest.approx(4 / 6)
    assert w["precision"] == pytest.approx((2 * 1 + 1 * 1 / 3 + 3 * 1) / 6)
    b = metrics.rmse_all_pairs(df).first()["rmse"]
    y, p = np.array(rows).T
    assert b == pytest.approx(np.sqrt(np.mean((p[:, None] - y[None]) ** 2)))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=12, max_size=60).filter(lambda v: np.std(v) > 0.1))
def test_partial_autocorrelations_fit_the_last_step(v):
    v = np.array(v) - np.mean(v)
    r = [float((v[k:] * v[: len(v) - k]).sum() / (v * v).sum()) for k in range(4)]
    toeplitz = np.array([[r[abs(i - j)] for j in range(3)] for i in range(3)])
    assert series.durbin_levinson(r)[3] == pytest.approx(np.linalg.solve(toeplitz, r[1:])[2], abs=1e-6)


def test_arima_recovers_simulated_parameters():
    rng = np.random.default_rng(3)
    e = rng.standard_normal(3001)
    x = np.zeros(3000)
    for t in range(1, 3000):
        x[t] = 0.7 * x[t - 1] + e[t]
    assert series.arima_fit(x + 5, 1, 0, 0)["ar"] == pytest.approx(0.7, abs=0.05)
    assert series.arima_fit(x + 5, 1, 0, 0)["mean"] == pytest.approx(5 + x.mean(), abs=0.1)
    ma = e[1:] + 0.5 * e[:-1]
    assert series.arima_fit(ma, 0, 0, 1)["ma"] == pytest.approx(0.5, abs=0.05)
    fit = series.arima_fit(np.cumsum(x), 1, 1, 1)
    assert fit["ar"] == pytest.approx(0.7, abs=0.06) and abs(fit["ma"]) < 0.08
    assert series.arima_forecast(np.cumsum(x), {"ar": 0.7, "ma": 0.0, "mean": 0.0}, 1, 2)[0] == pytest.approx(np.cumsum(x)[-1] + 0.7 * x[-1])


def test_unit_root_is_told_from_a_stationary_series():
    e = np.random.default_rng(5).standard_normal(300)
    assert series.adf_pvalue(series.adf_stat(e)[0]) < 0.01
    assert series.adf_pvalue(series.adf_stat(np.cumsum(e))[0]) > 0.05


def test_pvalues_are_those_of_random_walks():
    walks = np.cumsum(np.random.default_rng(7).standard_normal((20000, 400)), axis=1)
    x, y = walks[:, :-1], np.diff(walks, axis=1)
    xc, yc = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    sxx, sxy, syy = (xc * xc).sum(axis=1), (xc * yc).sum(axis=1), (yc * yc).sum(axis=1)
    t = np.sort(sxy / sxx / np.sqrt((syy - sxy**2 / sxx) / 397 / sxx))
    for p in (0.01, 0.05, 0.1, 0.3, 0.45, 0.6, 0.9):
        assert series.adf_pvalue(t[int(p * 20000)]) == pytest.approx(p, abs=0.015)
    assert (series.adf_pvalue(-30), series.adf_pvalue(5)) == (0.0, 1.0)


def test_nearest_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(1)
    x, q = rng.random((60, 3)), rng.random((9, 3))
    train = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, x array<double>, label int")
    query = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q long, x array<double>")
    got = {(r["q"], r["rn"]): r["id"] for r in learning.neighbours(train, query, 4).collect()}
    for i, v in enumerate(q):
        assert [got[i, k + 1] for k in range(4)] == np.argsort(((x - v) ** 2).sum(axis=1))[:4].tolist()


def test_neighbour_votes_by_brute_force(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 9, (150, 2)).astype(float), rng.integers(0, 2, 150)  # many ties
    rows = spark.createDataFrame([(i, i % 5, int(y[i]), *x[i].tolist()) for i in range(150)], "id long, fold int, y int, a double, b double").repartition(4)
    asked = rows.select(F.col("id").alias("q"), F.when(F.col("id") < 100, F.col("fold")).otherwise(-1).alias("fold"), "a", "b")
    got = {r["q"]: (r["k5"], r["k7"]) for r in learning.neighbour_votes(rows, asked, [5, 7], ["a", "b"], block=40).collect()}
    for i in range(150):
        near = sorted((j for j in range(150) if i >= 100 or j % 5 != i % 5), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))
        assert got[i] == pytest.approx((y[near[:5]].mean(), y[near[:7]].mean()))


def test_stacking_uses_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.random((400, 2)) * 8
    y = (x.astype(int).sum(axis=1) % 2).tolist()  # a chessboard: near rows tell it, lines and small trees don't
    df = spark.createDataFrame([(i, *x[i].tolist(), y[i]) for i in range(400)], "id long, a double, b double, y int")
    got = {r["id"]: r["pred"] for r in learning.stacking(df.where("id < 320"), df.where("id >= 320"), "id", ["a", "b"]).collect()}
    assert len(got) == 80 and np.mean([got[i] == y[i] for i in got]) > 0.65


def test_boosted_stumps_fit_what_one_stump_cannot(spark):
    df = spark.createDataFrame([(i, float(i), int(3 <= i < 7)) for i in range(10)], "id long, x double, y int")
    model = learning.adaboost(df, "id", ["x"], rounds=12)
    wrong = df.where(learning.boosted(model) != F.col("y")).count()
    assert len(model) > 1 and wrong <= 1


def test_chunks_cover_the_text(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "id int, t string")
    got = retrieval.chunks(df, "id", "t", 4, 3).orderBy("chunk_no").collect()
    assert [r["chunk"] for r in got] == ["abcd", "defg", "ghij", "j"]


def test_tables_are_made_and_dropped(spark, tmp_path):
    tables.create_tables(spark)
    assert spark.table("users").count() == 0
    tables.drop_tables(spark)
    path = tables.write_snapshot(spark.range(3).toDF("id"), str(tmp_path))
    assert spark.read.parquet(path).count() == 3
    assert tables.delete_paths(spark, [path, path]) == 1
    (tmp_path / "s.csv").write_text("date,value\n2020-01-02,2.5\n2020-01-01,1.5\n")
    assert [r["value"] for r in tables.read_series(spark, str(tmp_path / "s.csv")).collect()] == [1.5, 2.5]


def test_stream_and_batch_agree(spark, data, tmp_path):
    from brightloom.streaming.windows import windowed

    events = tables.table(spark, data, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="10 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("w").collect()) == sorted(windowed(events).collect())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_related_rows_are_neither_shuffled_nor_read_beyond_the_keys(spark, data):
    orders, customers = (tables.table(spark, data, n) for n in ("orders", "customer"))
    some = paging.page(orders.select("o_orderkey", "o_custkey"), [F.desc("o_orderkey")], 5, 10)
    got = paging.with_related(some, customers.select("c_custkey", "c_name"), "o_custkey", "c_custkey")
    plan = plan_of(got)
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "PushedFilters: [In(c_custkey" in plan
    names = {r["c_custkey"]: r["c_name"] for r in customers.collect()}
    assert [(r["o_custkey"], r["c_name"]) for r in got.collect()] == [(r["o_custkey"], names[r["o_custkey"]]) for r in some.collect()]
    rows = spark.createDataFrame([(1, 7), (2, None), (3, 9)], "id int, fk int")
    parents = spark.createDataFrame([(7, "a"), (None, "b")], "pk int, name string")
    assert sorted(map(tuple, paging.with_related(rows, parents, "fk", "pk").collect()), key=repr) == [(1, 7, 7, "a"), (2, None, None, None), (3, 9, None, None)]
    assert paging.with_related(rows.limit(0), parents, "fk", "pk").count() == 0
    with pytest.raises(ValueError):
        paging.with_related(spark.range(200).withColumn("fk", F.lit(7)), parents, "fk", "pk")


def test_ranks_in_classes(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a" if i % 3 else None, i % 4, "own") for i in range(200)], "id int, y string, _bucket int, _size string").repartition(3)
    got = ranking.ranked(df, F.floor(F.col("id") / 20), [F.col("id")], within=F.col("y"))
    assert got.columns == [*df.columns, "rank"]
    for y in ("a", None):
        of = sorted((r["id"], r["rank"]) for r in got.collect() if r["y"] == y)
        assert [n for _, n in of] == list(range(1, len(of) + 1))
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 3)
    assert ranking.digits_for(3 * 16**2) == 2 and ranking.digits_for(0) == 1
    split = learning.stratified_split(df, "id", "y", 0.3)
    assert {(r["y"], r["is_test"]): r["count"] for r in split.groupBy("y", "is_test").count().collect()} == {("a", True): 40, ("a", False): 93, (None, True): 21, (None, False): 46}
    folds = learning.stratified_folds(df, "id", "y", 5).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds if r["y"] == "a"} <= {26, 27} and len(folds) == 10
    for rows in (split, learning.stratified_folds(df, "id", "y", 5)):  # ranks are taken in buckets of a class, never in a whole class
        windows = [x for x in plan_of(rows).split("\n") if "row_number()" in x and "windowspecdefinition" in x]
        assert windows and all("_bucket" in x.split("windowspecdefinition")[1].split("ASC")[0] for x in windows)


def test_new_rows_come_one_after_the_other(spark):
    kind = "id int, n string, e string"
    old = spark.createDataFrame([(0, "Old", "old@x")], kind)
    ids = lambda new, keys=("n", "e"): sorted(r["id"] for r in snapshot.insert_unique(old, spark.createDataFrame(new, kind).repartition(3), list(keys), "id").collect())
    assert ids([(1, "n1", "e1"), (2, "n2", "E1"), (3, "N2", "e3")]) == [0, 1, 3]
    assert ids([(1, "old", "a"), (2, "a", "OLD@x"), (3, "b", None), (4, "c", None), (5, None, None)]) == [0, 3, 4, 5]
    assert ids([(2, "x", "b"), (1, "X", "a")], ["n"]) == [0, 1]
    assert ids([(7, "x", "a"), (7, "x", "a")]) == [0, 7] and ids([]) == [0]
    rng = np.random.default_rng(1)
    new = [(i, f"n{rng.integers(12)}", f"e{rng.integers(12)}") for i in range(1, 40)]
    names, mails, want = {"old"}, {"old@x"}, [0]
    for i, n, e in new:
        if n not in names and e not in mails:
            names.add(n), mails.add(e), want.append(i)
    assert ids(new) == want
    odd = [f"{n} string" for n in ("_row", "_first", "_first0", "_taken", "_n", "_key", "_gone")]
    wide = spark.createDataFrame([(1, "n1", "e1", *"abcdefg"), (1, "n1", "e2", *"abcdefg")], ", ".join([kind, *odd]))
    for keys in (["n"], ["n", "e"]):
        got = snapshot.insert_unique(wide.limit(0), wide, keys, "id")
        assert got.columns == wide.columns and got.count() == 1 and tuple(got.first())[3:] == tuple("abcdefg")
    assert snapshot.replace_by(wide, wide, "id").count() == 1 and snapshot.put(wide.limit(1), wide, "id", ["_n"]).columns == wide.columns
    assert snapshot.delete_cascade(wide, F.col("e") == "e1", "id", {"c": (wide, "id")})[1]["c"].count() == 0
    folded = snapshot.insert_unique(old, spark.createDataFrame([(1, "A", "MAIL@X")], kind), ["n", "e"], "id", folded=("e",))
    assert (1, "A", "mail@x") in [tuple(r) for r in folded.collect()]


def test_of_several_changes_of_a_row_the_last_counts(spark):
    old = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (None, "n", "n")], "id int, x string, y string")
    changes = spark.createDataFrame([(1, "p", "q", 1, ["x", "y"]), (1, "r", None, 2, ["y"]), (1, "s", "t", 0, ["x"]), (None, "z", "z", 9, ["x"]), (3, "z", "z", 9, ["x"]), (2, "u", "u", 1, None)], "id int, x string, y string, at int, fields_set array<string>")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(snapshot.patch(old, changes, "id", ["x", "y"], "at")) == [(1, "p", None), (2, "c", "d"), (None, "n", "n")]
    assert rows(snapshot.put(old, changes, "id", ["x", "y"], "at")) == [(1, "r", None), (2, "u", "u"), (None, "n", "n")]
    new = spark.createDataFrame([(1, "a1", "k"), (1, "a2", "j"), (4, "a", "b"), (None, "m", "m")], old.schema)
    assert rows(snapshot.replace_by(old, new, "id", "x")) == [(1, "a2", "j"), (2, "c", "d"), (4, "a", "b"), (None, "m", "m"), (None, "n", "n")]
    assert rows(snapshot.replace_by(old, new, "id")) == rows(snapshot.replace_by(old, new, "id", "x"))


def test_changed_values_must_be_free(spark):
    old = spark.createDataFrame([(1, "Ann", "a@x"), (2, "Bob", "b@x"), (3, "Cid", "c@x"), (4, None, "d@x")], "id int, name string, mail string")
    kind = "id int, name string, mail string, at int, fields_set array<string>"
    changes = [(1, "ANN", None, 1, ["name"]), (2, "ann", None, 2, ["name"]), (3, "New", "B@X", 3, ["name", "mail"]), (4, "new", None, 4, ["name"]), (2, "bob", "z@x", 5, ["name", "mail"]), (1, None, None, 6, ["mail"]), (9, "Ann", None, 7, ["name"])]
    refused = snapshot.refused_changes(old, spark.createDataFrame(changes, kind), "id", ["name", "mail"], "at")
    assert sorted(r["at"] for r in refused.collect()) == [2, 3, 4]
    got = snapshot.patch_unique(old, spark.createDataFrame(changes, kind), "id", ["name", "mail"], ["name", "mail"], "at")
    assert sorted(map(tuple, got.collect())) == [(1, "ANN", None), (2, "bob", "z@x"), (3, "Cid", "c@x"), (4, None, "d@x")]


def test_writes_that_break_a_rule_leave_nothing(spark, tmp_path):
    users = spark.createDataFrame([(1, "Ann", "a@x", "h", None), (2, "Bob", "b@x", "h", None)], tables.SCHEMAS["users"])
    tokens = lambda rows: spark.createDataFrame([(i, u, t, *[np.datetime64("2024-01-01").item()] * 2) for i, u, t in rows], "id int, user_id int, token_hash string, expires_at date, created_at date")
    path = tables.write_checked(users, str(tmp_path), tables.table_rules("users", {}))
    assert spark.read.parquet(path).count() == 2
    clash = users.unionByName(users.where("id = 1").withColumns({"id": F.lit(3), "username": F.lit("aNN"), "email": F.lit("n@x")}))
    with pytest.raises(tables.ConstraintError, match="unique username") as e:
        tables.write_checked(clash, str(tmp_path / "bad"), tables.table_rules("users", {}))
    assert e.value.broken == ["unique username"] and not list((tmp_path / "bad").glob("snapshot-*"))
    rules = tables.table_rules("password_reset_tokens", {"users": users})
    for rows, broken in (([(1, 1, "t"), (2, 2, "u")], []), ([(1, 9, "t"), (1, 2, None)], ["required", "primary key", "foreign user_id"])):
        if broken:
            with pytest.raises(tables.ConstraintError) as e:
                tables.write_checked(tokens(rows), str(tmp_path / "t"), rules)
            assert e.value.broken == broken
        else:
            tables.write_checked(tokens(rows), str(tmp_path / "t"), rules)
    assert {n: spark.read.parquet(p).count() for n, p in tables.truncated(spark, str(tmp_path / "none")).items()} == dict.fromkeys(tables.SCHEMAS, 0)
    assert list(tables.empty_tables(spark)) == ["password_reset_tokens", "posts", "users"]


def test_external_store_from_the_environment(spark, monkeypatch):
    with pytest.raises(ValueError, match="DATABASE_URL"):
        tables.jdbc_options({})
    assert tables.jdbc_options({"DATABASE_URL": "postgresql://h/d", "DATABASE_USER": "u"}) == {"url": "jdbc:postgresql://h/d", "user": "u"}
    spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name")).write.format("jdbc").options(url="jdbc:derby:memory:store;create=true", dbtable="rows_of").save()
    monkeypatch.setenv("DATABASE_URL", "derby:memory:store")
    got = tables.read_jdbc(spark, "rows_of", key="id", low=0, high=100, parts=4)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 100
    assert tables.read_jdbc(spark, "rows_of", url="jdbc:derby:memory:store").where("id = 7").first()[1] == "n7"


def test_small_scalars(spark):
    row = spark.range(1).select(
        *[scalar.truncated(F.lit(x), 3).alias(f"t{i}") for i, x in enumerate((-0.12345, 0.12399, None, 5.0))],
        scalar.joined_messages(F.array(F.struct(F.lit("a").alias("msg")), F.struct(F.lit("b").alias("msg")))).alias("m"), scalar.picture_name().alias("p"), scalar.picture_name().alias("q"),
    ).first()
    assert row[:5] == (-0.123, 0.123, None, 5.0, "a. b")
    assert row["p"] != row["q"] and len(row["p"]) == 36 and row["p"].endswith(".jpg") and int(row["p"][:32], 16)
    assert len({scalar.reset_token() for _ in range(50)}) == 50 and len(scalar.reset_token()) >= 43
    ids = snapshot.next_ids(spark.createDataFrame([("b",), ("a",), ("c",)], "k string"), 40, F.lit(0), [F.col("k")])
    assert sorted((r["k"], r["id"]) for r in ids.collect()) == [("a", 41), ("b", 42), ("c", 43)]
    bad = validation.not_null(spark.createDataFrame([(1, None), (None, "x"), (2, "y")], "a int, b string"), ["a", "b"])
    assert bad.count() == 2 and validation.not_unique(spark.createDataFrame([(None,), (None,), (1,)], "a int"), F.col("a")).count() == 0


def test_series_without_variation_or_days(spark):
    day = lambda i: f"2024-01-{i:02d}"
    rng = np.random.default_rng(6)
    rows = [("flat", day(i), 5.0) for i in range(1, 20)] + [("one", day(1), 1.0)] + [("some", day(i), float(rng.normal())) for i in range(1, 29)] + [("some", "2024-01-29", None), ("some", None, 3.0)]
    df = spark.createDataFrame(rows, "series_id string, ds string, value double").withColumn("ds", F.to_date("ds"))
    known = df.where("series_id = 'some' and ds is not null and value is not null")
    of = lambda f: {r["series_id"]: tuple(r)[1:] for r in f.collect()}
    a = series.acf(df, 3).collect()
    assert all((r["acf"] is None) == (r["series_id"] != "some") == (r["band"] is None) for r in a) and len(a) == 12
    assert all((r["pacf"] is None) == (r["series_id"] != "some") for r in series.pacf(df, 3).collect())
    for f, width in ((series.adf, 3), (lambda x: series.arima(x, 1, 0, 1), 3), (series.df_tstat, 1)):
        got = of(f(df))
        assert got.get("flat", (None,) * width) == got.get("one", (None,) * width) == (None,) * width
        assert got["some"] == pytest.approx(of(f(known))["some"]) and None not in got["some"]
    held = series.arima_holdout(df, 1, 1, 1).collect()
    assert all((r["y_pred"] is None) == (r["series_id"] != "some") for r in held) and len(held) == 7 + 5 + 1
    f = series.ar1_forecast(df, 2).collect()
    assert all((r["forecast"] is None) == (r["series_id"] != "some") for r in f)
    walk = spark.createDataFrame([("w", day(i), float(2 * i)) for i in range(1, 9)], "series_id string, ds string, value double")
    assert [round(r["forecast"], 6) for r in series.ar1_forecast(walk, 2).orderBy("h").collect()] == [18.0, 20.0]
    for g in (series.gaps, series.diff, series.ordered_split, series.acf, series.pacf, series.adf, series.ar1_cls, lambda x: series.arima(x, 0, 0, 1)):
        assert g(df.limit(0)).count() == 0


def test_likelihood_is_that_of_the_joint_normal():
    """The filter's likelihood against the density with the full covariance matrix, around and at the fit."""
    v = np.cumsum(np.random.default_rng(9).standard_normal(25)) * 0.3 + np.random.default_rng(8).standard_normal(25)

    def dense(ar, ma, w, mean):
        n, psi = len(w), [1.0]
        for _ in range(4000):
            psi.append(psi[-1] * ar + (ma if len(psi) == 1 else 0))
        psi = np.array(psi)
        gamma = [float((psi[: len(psi) - k] * psi[k:]).sum()) for k in range(n)]
        cov = np.array([[gamma[abs(i - j)] for j in range(n)] for i in range(n)])
        inv, ones = np.linalg.inv(cov), np.ones(n)
        m = float(ones @ inv @ w / (ones @ inv @ ones)) if mean else 0.0
        e = w - m
        return n * np.log(e @ inv @ e / n) + np.linalg.slogdet(cov)[1], m

    for p, d, q in ((1, 0, 0), (0, 0, 1), (1, 1, 1)):
        w = np.diff(v) if d else v
        fit = series.arima_fit(v, p, d, q)
        least, m = dense(fit["ar"], fit["ma"], w, not d)
        assert fit["mean"] == pytest.approx(m, abs=1e-6)
        for a in (-0.02, 0.0, 0.02):
            for b in (-0.02, 0.0, 0.02):
                if abs(fit["ar"] + a * p) < 0.99 and abs(fit["ma"] + b * q) < 0.99:
                    assert dense(fit["ar"] + a * p, fit["ma"] + b * q, w, not d)[0] >= least - 1e-6


def test_unit_root_statistic_by_least_squares():
    v = np.cumsum(np.random.default_rng(2).standard_normal(60))
    t, lag = series.adf_stat(v)
    d = np.diff(v)
    scores = {}
    for k in range(int(np.ceil(12 * 0.6**0.25)) + 1):
        skip = int(np.ceil(12 * 0.6**0.25))
        x = np.array([[v[i], *[d[i - j] for j in range(1, k + 1)], 1.0] for i in range(skip, len(d))])
        y = d[skip:]
        b = np.linalg.solve(x.T @ x, x.T @ y)
        scores[k] = len(y) * np.log(((y - x @ b) ** 2).sum() / len(y)) + 2 * (k + 2)
    assert lag == min(scores, key=scores.get)
    x = np.array([[v[i], *[d[i - j] for j in range(1, lag + 1)], 1.0] for i in range(lag, len(d))])
    y = d[lag:]
    b = np.linalg.solve(x.T @ x, x.T @ y)
    s2 = ((y - x @ b) ** 2).sum() / (len(y) - lag - 2)
    assert t == pytest.approx(b[0] / np.sqrt(s2 * np.linalg.inv(x.T @ x)[0, 0]))


@pytest.mark.parametrize(("cell", "part", "block"), [(16384, 16384, 4096), (8, 3, 5), (30, 16384, 2)])
def test_search_of_any_vectors(spark, monkeypatch, cell, part, block):
    monkeypatch.setattr(nearest, "CELL", cell)
    monkeypatch.setattr(nearest, "PART", part)
    monkeypatch.setattr(nearest, "QUERIES", block)
    rng = np.random.default_rng(1)
    x = [rng.integers(0, 4, 3).astype(float).tolist() for _ in range(90)] + [None, [1.0, None, 2.0], [1.0, 2.0], [0.0, 0.0, 0.0], []]
    table = spark.createDataFrame([(i, v, f"l{i % 3}", "qx") for i, v in enumerate(x)] + [(None, [1.0, 1.0, 1.0], "l", "qx")], "id long, x array<double>, label string, qx string").repartition(4)
    asked = [(i, x[i]) for i in range(0, 95, 3)] + [(3, x[3]), (None, x[3])]
    query = spark.createDataFrame(asked, "q long, x array<double>").repartition(2)
    ok = lambda v: v is not None and len(v) and None not in v
    got = sorted((r["q"], r["rn"], r["id"], r["label"], round(r["d"], 6)) for r in learning.neighbours(table, query, 4).collect())
    want = []
    for q, v in asked:
        if q is not None and ok(v):
            near = sorted((round(float(np.linalg.norm(np.array(v) - w)), 8), i) for i, w in enumerate(x) if ok(w) and len(w) == len(v))[:4]
            want += [(q, n, i, f"l{i % 3}", round(d, 6)) for n, (d, i) in enumerate(near, 1)]
    assert got == sorted(want)
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 8)
    found = sorted((r["q"], r["rn"], r["id"], round(r["score"], 6)) for r in retrieval.cosine_topk(table.select("id", F.col("x").alias("v")), query.select("q", F.col("x").alias("qv")), 3).collect())
    want = []
    for q, v in asked:
        if q is not None and ok(v) and any(v):
            near = sorted((-cos(v, w), i) for i, w in enumerate(x) if ok(w) and any(w) and len(w) == len(v) and i != q)[:3]
            want += [(q, n, i, round(-d, 6)) for n, (d, i) in enumerate(near, 1)]
    assert found == sorted(want)
    assert learning.neighbours(table.limit(0), query, 2).count() == 0 and learning.neighbours(table, query.limit(0), 2).count() == 0


def test_pivots_rule_out_cells(spark, monkeypatch):
    """Clustered rows, a third of them alike: the same rows as by trying all, from a share of the rows that falls as the table grows."""
    monkeypatch.setattr(nearest, "CELL", 50)
    monkeypatch.setattr(nearest, "PART", 60)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 6)) * 20
    shares = []
    for n in (600, 3600):
        x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 6))
        x[: n // 3] = x[0]
        rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
        table = spark.createDataFrame(rows, "id long, x array<double>, label int").repartition(4)
        query = table.where("id % 20 = 0").select(F.col("id").alias("q"), "x")
        for cosine in (False, True):
            search = nearest.Search(table, query, 3, cosine)
            got = sorted((r["q"], r["rn"], r["id"], r["label"], round(r["found"], 7)) for r in search.result().collect())
            want = []
            for q in range(0, n, 20):
                if cosine:
                    v = -np.round(x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q]), 8)
                    v[q] = np.inf
                else:
                    v = np.round(np.linalg.norm(x - x[q], axis=1), 8)
                order = np.lexsort((np.arange(n), v))[:3]
                want += [(q, m, int(i), int(i) % 3, round(float(abs(v[i]) if not cosine else -v[i]), 7)) for m, i in enumerate(order, 1)]
            assert got == sorted(want)
            met = search.compared().where("q >= %d" % (n // 3 + 1)).agg(F.avg("rows")).first()[0] / n
            assert met < 0.5
            if not cosine:
                shares.append(met)
    assert shares[1] < 0.7 * shares[0]


def best_split(rows, features):
    """(gini, feature, threshold, left, right) by trying all midpoints."""
    best = None
    for j, f in enumerate(features):
        values = sorted({x[j] for x, _, _ in rows if x[j] is not None})
        for a, b in zip(values, values[1:]):
            sides = [[(y, w) for x, y, w in rows if x[j] is not None and (x[j] <= a) == low] for low in (True, False)]
            n = [sum(w for _, w in s) for s in sides]
            p = [sum(w for y, w in s if y) / m for s, m in zip(sides, n)]
            gini = sum(m * (1 - r * r - (1 - r) * (1 - r)) for m, r in zip(n, p)) / sum(n)
            new = (round(gini, 12), f, (a + b) / 2, int(p[0] >= 0.5), int(p[1] >= 0.5))
            best = min(best or new, new)
    return best


def test_stumps_in_ranges_by_trying_all(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [((float(rng.integers(0, 40)), None if i % 9 == 0 else float(rng.normal())), int(rng.random() < 0.4 + 0.01 * (i % 40)), float(rng.integers(1, 4))) for i in range(300)]
    df = spark.createDataFrame([(i, *x, y, w) for i, (x, y, w) in enumerate(rows)], "id int, a double, b double, y int, w double").repartition(3)
    monkeypatch.setattr(learning, "STUMP_ROWS", 30)
    assert all(len(e) > 5 for e in learning.value_edges(df, ["a", "b"]).values())
    got = learning.stump(df, ["a", "b"], weight="w")
    assert tuple(got.first())[:3] == pytest.approx((best_split(rows, "ab")[1], best_split(rows, "ab")[2], best_split(rows, "ab")[0]))
    running = [x for x in plan_of(got).split("\n") if "windowspecdefinition(feature" in x and "x#" in x]
    assert running and all("part#" in x for x in running)  # no window over all values of a feature
    assert learning.stump(df.where("a = 3").select("y", F.lit(1.0).alias("a")), ["a"]).count() == 0
    assert learning.stump(df.limit(0), ["a", "b"]).count() == 0


def test_boosting_by_plain_loops(spark):
    rng = np.random.default_rng(7)
    x = [(float(rng.integers(0, 12)), float(rng.integers(0, 12))) for _ in range(80)]
    y = [int((a > 5) != (b > 3) or rng.random() < 0.1) for a, b in x]
    df = spark.createDataFrame([(i, *v, t) for i, (v, t) in enumerate(zip(x, y))], "id int, a double, b double, y int")
    model = learning.adaboost(df, "id", ["a", "b"], rounds=8)
    w = [1.0] * 80
    for f, threshold, left, right, alpha in model:
        gini, *split = best_split([(v, t, u) for v, t, u in zip(x, y, w)], "ab")
        assert [f, threshold, left, right] == split
        wrong = [(left if v["ab".index(f)] <= threshold else right) != t for v, t in zip(x, y)]
        e = sum(u for u, bad in zip(w, wrong) if bad) / sum(w)
        assert alpha == pytest.approx(np.log((1 - e) / e))
        total = sum(w)
        w = [u * ((1 - e) / e if bad else 1.0) / total for u, bad in zip(w, wrong)]
    assert len(model) == 8


def test_logistic_regression_reaches_the_least_loss(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=200) > 0).astype(int)
    df = learning.assembled(spark.createDataFrame([(*map(float, v), int(t)) for v, t in zip(x, y)], "a double, b double, y int"), ["a", "b"])
    model = learning.classifier("logistic", "y", 200).fit(df)
    a, v = np.hstack([x, np.ones((200, 1))]), np.zeros(3)
    ridge = np.diag([1.0, 1.0, 0.0])
    for _ in range(30):  # Newton's steps on the summed loss with C = 1
        p = 1 / (1 + np.exp(-a @ v))
        v -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ v)
    assert [*model.coefficients.toArray(), model.intercept] == pytest.approx(v.tolist(), abs=1e-3)


def test_likelihood_with_missing_days_is_that_of_the_joint_normal():
    """Days left out of the covariance matrix; with d=1, of the changes since the first day that is there."""
    rng = np.random.default_rng(3)
    for d in (0, 1):
        v = rng.standard_normal(24) * 0.5 + np.convolve(rng.standard_normal(25), [1, 0.4])[1:25]
        v = np.cumsum(v) if d else v + 3
        v[[0, 1, 5, 9, 10, 11, 20]] = np.nan
        there = np.flatnonzero(~np.isnan(v))
        for ar, ma in ((0.5, 0.3), (-0.4, 0.2), (0.0, -0.6), (0.9, 0.0)):
            psi = np.array([1.0, *((ar + ma) * ar ** np.arange(3000))])
            gamma = np.array([float((psi[: len(psi) - k] * psi[k:]).sum()) for k in range(24)])
            cov = gamma[np.abs(np.arange(24)[:, None] - np.arange(24))]
            pick = np.array([[float(there[0] < j <= t) if d else float(j == t) for j in range(24)] for t in there[d:]])
            cov, y = pick @ cov @ pick.T, v[there[d:]] - (v[there[0]] if d else 0)
            inv, one = np.linalg.inv(cov), np.ones(len(y))
            m = 0.0 if d else float(one @ inv @ y / (one @ inv @ one))
            n, square, logs, mean, _ = (x[0, 0] if x.ndim == 2 else x for x in series._filtered(np.stack([v, v[::-1]]), np.array([[ar]]), np.array([[ma]]), d, not d))
            assert (n, square, logs, mean) == pytest.approx((len(y), (y - m) @ inv @ (y - m), np.linalg.slogdet(cov)[1], m), rel=1e-6, abs=1e-8)
            # the forecast is the mean of the days to come, given those that are there
            full = np.array([[float((psi[: len(psi) - abs(i - j)] * psi[abs(i - j) :]).sum()) for j in range(27)] for i in range(27)])
            wide = np.array([[float(there[0] < j <= t) if d else float(j == t) for j in range(27)] for t in [*there[d:], 24, 25, 26]])
            c = wide @ full @ wide.T
            told = m + c[-3:, :-3] @ inv @ (y - m) + (v[there[0]] if d else 0)
            assert series.arima_forecast(v, {"ar": ar, "ma": ma, "mean": m}, d, 3) == pytest.approx(told, abs=1e-6)


def test_fits_of_many_series_with_gaps(spark, monkeypatch):
    """Series that span batches and share one array have the fits that each has alone; days that are missing aren't neighbours."""
    rng, rows, alone = np.random.default_rng(12), [], {}
    for k in [*range(70), None]:
        v = rng.standard_normal(30 + (k or 0) % 9)
        keep = [i for i in range(len(v)) if i == 0 or i % (5 + (k or 0) % 3)]
        rows += [(k, datetime.date(2024, 1, 1) + datetime.timedelta(i), float(v[i])) for i in keep]
        alone[k] = np.array([v[i] if i in keep else np.nan for i in range(max(keep) + 1)])
    df = spark.createDataFrame(rows, "series_id int, ds date, value double").repartition(5)
    got = {r["series_id"]: tuple(r)[1:] for r in series.arima(df, 1, 0, 1).collect()}
    assert got.keys() == alone.keys()
    for k in (0, 3, 35, 69, None):
        assert got[k] == pytest.approx(tuple(series.arima_fit(alone[k], 1, 0, 1).values()), abs=1e-9)
    days = {(r["series_id"], r["ds"]): r["value"] for r in series.spine(df).collect()}
    assert len(days) == sum(map(len, alone.values()))
    for k, v in alone.items():
        assert [days[k, datetime.date(2024, 1, 1) + datetime.timedelta(i)] for i in range(len(v))] == [None if np.isnan(x) else x for x in v.tolist()]
    held = [r for r in series.arima_holdout(df, 1, 1, 1).collect() if r["series_id"] == 7]
    known = [r for r in rows if r[0] == 7]
    cut = int(len(known) * 0.75)
    v = alone[7][: (known[cut - 1][1] - known[0][1]).days + 1]
    told = series.arima_forecast(v, series.arima_fit(v, 1, 1, 1), 1, 20)
    assert {r["ds"]: r["y_pred"] for r in held} == pytest.approx({t[1]: told[(t[1] - known[cut - 1][1]).days - 1] for t in known[cut:]})
