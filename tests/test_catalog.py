"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import math

import duckdb
import pytest

from brightloom.operators import learning
from brightloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks".split()


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


def rows_of(names, columns, rows):
    at = [columns.index(n) for n in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    names = sorted(df.columns)
    q = duck.sql(catalog.SQL[name])
    assert sorted(q.columns) == names
    assert rows_of(names, df.columns, df.collect()) == rows_of(names, list(q.columns), q.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize(("name", "of", "extra"), [("scan_project", "lineitem", 0), ("string_fns", "orders", 0), ("authz_decision", "orders", 1)])
def test_whole_tables_are_read(spark, data, duck, name, of, extra):
    assert catalog.QUERIES[name](spark, data).count() == duck.sql(f"select count(*) from {of}").fetchall()[0][0] + extra


def test_new_rows_of_all_customers_are_inserted(spark, data, duck):
    n, odd = duck.sql("select count(*), count(distinct c_custkey // 4) filter (c_custkey % 2 = 1) from customer").fetchall()[0]
    assert catalog.QUERIES["dml_insert_unique"](spark, data).count() == n + odd


def test_ensembles_have_the_size_of_the_reference(spark, data, monkeypatch):
    asked = {}

    def stopped(kind):
        def f(*_, **more):
            asked[kind] = more
            raise StopIteration

        return f

    monkeypatch.setattr(learning, "adaboost", stopped("adaboost"))
    monkeypatch.setattr(learning, "classifier", stopped("forest"))
    for name in ("adaboost_fit", "rf_classify"):
        with pytest.raises(StopIteration):
            catalog.QUERIES[name](spark, data)
    assert asked["adaboost"]["rounds"] == 60 and asked["forest"] == {"maxDepth": 30}


def test_autocorrelations_reach_lag_20(spark, data):
    assert {r["lag"] for r in catalog.QUERIES["ts_acf"](spark, data).select("lag").distinct().collect()} == set(range(21))


@pytest.mark.parametrize(("name", "least"), [("dt_classify", 0.9), ("rf_classify", 0.9), ("logreg", 0.8), ("adaboost_fit", 0.9), ("stacking", 0.9)])
def test_classifiers_tell_the_classes_apart(spark, name, least):
    rows = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
    y = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [(int(r["pred"]), y[r["doc_id"]]) for r in rows.collect()]
    assert len(got) == len({r["doc_id"] for r in rows.collect()}) >= 0.3 * len(y) - 1
    assert sum(p == t for p, t in got) / len(got) > least


def test_regression_tree_is_better_than_the_mean(spark):
    got = [(r["y"], r["pred"]) for r in catalog.QUERIES["dt_regress"](spark, "/root/testdata/sf0.01").collect()]
    mean = sum(y for y, _ in got) / len(got)
    assert sum((y - p) ** 2 for y, p in got) < 0.5 * sum((y - mean) ** 2 for y, _ in got)


def test_votes_of_five_and_means_of_three(spark, data):
    from collections import Counter

    members = {}
    for r in catalog._knn_members(spark, data).collect() + [r for n in (3, 4) for r in catalog._trees(spark, data, "tree", n).collect()]:
        members.setdefault(r["q"], []).append(int(r["pred"]))
    assert all(len(x) == 5 for x in members.values())
    want = {q: min(Counter(x).items(), key=lambda c: (-c[1], c[0]))[0] for q, x in members.items()}
    assert {r["q"]: r["vote"] for r in catalog.QUERIES["hard_vote_five"](spark, data).collect()} == want
    import numpy as np

    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    train, asked = ([r for r in rows if (r["vec_id"] % 20 == 0) == q] for q in (False, True))
    a = np.hstack([np.array([r["embedding"] for r in train], float), np.ones((len(train), 1))])
    y = np.array([r["label"] for r in train], float)
    line = np.linalg.lstsq(a, y, rcond=None)[0]
    tree = {r["q"]: r["pred"] for r in catalog._trees(spark, data, "regression_tree", 5).collect()}
    got = {r["q"]: r["pred"] for r in catalog.QUERIES["vote_regress_three"](spark, data).collect()}
    for r in asked:
        v = np.array(r["embedding"], float)
        near = sorted((round(float(np.linalg.norm(v - np.array(t["embedding"], float))), 8), t["vec_id"], t["label"]) for t in train)[:5]
        assert got[r["vec_id"]] == pytest.approx((np.append(v, 1) @ line + sum(x[2] for x in near) / 5 + tree[r["vec_id"]]) / 3, abs=1e-4)


def test_forecast_errors_by_numpy(spark, data):
    import numpy as np

    held = catalog.QUERIES["ts_arima111"](spark, data).collect()
    for r in catalog.QUERIES["ts_forecast_rmse"](spark, data).collect():
        y, p = np.array([(x["y_true"], x["y_pred"]) for x in held if x["series_id"] == r["series_id"]]).T
        assert r["rmse"] == pytest.approx(np.sqrt(np.mean((p - y) ** 2)))
        assert r["rmse_all_pairs"] == pytest.approx(np.sqrt(np.mean((p[:, None] - y[None]) ** 2)))
