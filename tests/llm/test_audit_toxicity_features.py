"""The filter audit, toxicity and the point-in-time table against plain loops, on small tables with every listed oddity."""

import datetime as dt
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightloom.llm import common, filter_audit, langid, queries, time_tree, toxicity

START = dt.datetime(2024, 1, 1)
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, lo long, cell long, at string"
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, client string, hi int"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, item string, n int"


def shop(rnd, fractions, n=60):
    """Sales, clicks and lines of a few clients, one of them with most rows; with nulls, repeats, late and broken rows."""
    when = lambda days: START + dt.timedelta(seconds=rnd.randrange(int(days * 86400)), microseconds=rnd.randrange(1_000_000) if fractions else 0)
    some = lambda x: None if rnd.random() < 0.05 else x
    client = lambda: some(1 if rnd.random() < 0.6 else rnd.randrange(5))
    late = lambda at: some(at + dt.timedelta(seconds=rnd.choice([-90_000, 0, 3, 5000, 400_000, 2_000_000]))) if at else None
    sales = []
    for i in range(n):
        at = some(when(9))
        sales.append((None if i == 7 else i, client(), "x", some(rnd.choice([12.345, -3.0, 0.005, float("nan"), 1e300])), at, late(at), 1, 0, 0, "z"))
    clicks = []
    for i in range(2 * n):
        at = some(when(9))
        clicks.append((some(rnd.randrange(-5, n)), at, late(at), client(), some(rnd.choice(["purchase", "view"])), some(rnd.random() * 9), "{}", "c", 1))
    clicks += clicks[:20]
    lines = []
    for i in range(3 * n):
        k = some(rnd.randrange(n + 5))
        lines.append((k, 1, some(rnd.randrange(4)), 1, 1, some(rnd.random() * 9), 0.0, "f", some(when(20).replace(hour=0, minute=0, second=0, microsecond=0)), "i", 2))
    return sales, clicks, lines + lines[:15]


def cents(x):
    return 0 if x is None or math.isnan(x) or abs(x) > 1e15 else math.floor(100 * x + 0.5)


def plain_table(sales, clicks, lines, windows, lag, horizon):
    day, lag = dt.timedelta(days=1), dt.timedelta(minutes=lag)
    out = []
    for s in sales:
        if s[1] is None or s[4] is None:
            continue
        t = s[4] + dt.timedelta(seconds=zlib.crc32(("" if s[0] is None else str(s[0])).encode()) % 259200)
        label = any(o[1] == s[1] and o[4] and t < o[4] <= t + horizon * day for o in sales)
        for d in windows:
            inside = lambda at, arrived: at is not None and arrived is not None and t - d * day < at <= t and arrived + lag <= t  # noqa: B023, E731
            c = [x for x in set(clicks) if x[3] == s[1] and inside(x[1], x[2])]
            o = [x for x in sales if x[1] == s[1] and inside(x[4], x[5])]
            li = [x for y in o for x in lines if x[0] is not None and x[0] == y[0] and x[8] is not None and x[8] <= t]
            last = max(c, key=lambda x: (x[1], x[0] is not None, x[0] or 0))[0] if c else None
            out.append((s[0], d, (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1), label, len(c), sum(x[4] == "purchase" for x in c), sum(cents(x[5]) for x in c), last, len(o), sum(cents(x[3]) for x in o), len(li), len({x[2] for x in li} - {None}), sum(cents(x[5]) for x in li)))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("seed", "fractions", "bucket"), [(1, False, 1), (2, True, 1), (3, False, 64), (4, False, 3)])
def test_features_by_plain_loops(spark, seed, fractions, bucket):
    common.prepare(spark)
    sales, clicks, lines = shop(random.Random(seed), fractions)
    frames = [spark.createDataFrame(rows, kind).repartition(3) for rows, kind in ((clicks, CLICKS), (sales, SALES), (lines, LINES))]
    got = time_tree.point_in_time(*frames, windows=(1, 4), lag_minutes=240, horizon=2, bucket=bucket)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_table(sales, clicks, lines, (1, 4), 240, 2)


def test_repeated_sales_and_empty_tables(spark):
    common.prepare(spark)
    sales, clicks, lines = shop(random.Random(5), False, 12)
    sales += sales[:4]
    empty = [spark.createDataFrame([], k) for k in (CLICKS, SALES, LINES)]
    full = [spark.createDataFrame(rows, kind) for rows, kind in ((clicks, CLICKS), (sales, SALES), (lines, LINES))]
    got = time_tree.point_in_time(*full, windows=(1, 4), horizon=2)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_table(sales, clicks, lines, (1, 4), 240, 2)
    assert time_tree.point_in_time(*empty).count() == 0
    got = time_tree.point_in_time(empty[0], full[1], empty[2], windows=(1, 4), horizon=2)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_table(sales, [], [], (1, 4), 240, 2)


def test_canonical_nodes_cover_an_interval_once(spark):
    rnd = random.Random(6)
    rows = [(i, a, (m := rnd.randrange(a, 64)), rnd.randrange(m, 65)) for i in range(200) for a in [rnd.randrange(64)]]
    df = spark.createDataFrame(rows, "client long, lo long, mid long, hi long").selectExpr("*", "0 as kind", "1L as n", "0L as p", "0L as c", "cast(null as decimal(38,0)) as x", "6 as top", "0 as below")
    got = defaultdict(Counter)
    for r in time_tree._canonical(df).collect():
        got[r["client"], r["short"]].update(range(r["node"] << r["level"], (r["node"] + 1) << r["level"]))
    for i, a, m, b in rows:
        assert got[i, True] == Counter(range(a, m)) and got[i, False] == Counter(range(m, b))


def test_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    times = [START, dt.datetime(2024, 3, 31, 2, 30, 0, 5), dt.datetime(1969, 12, 31, 23, 59, 59, 500_000), None]
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t timestamp_ntz").orderBy("i").select(time_tree.micros(F.col("t"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [None if t is None else (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for t in times]


# ---- Filter audit ---------------------------------------------------------------------------------


def odd_texts():
    rnd = random.Random(8)
    out = [None, "", " \t\n", "A", "a#", "é É x", "\x0b\x0c", "\x1f", "a b", "one two one", "ONE one One"]
    out += [" ".join(rnd.choice(["w", "W", "é", "x$", "longer", "ÄÖ"]) + str(rnd.randrange(m)) for _ in range(n)) for n in (5, 199, 200, 201, 400) for m in (3, 100, 5000)]
    out += ["z" * 3000 + " y " * 2000, "end", "end", "", None] + out[-4:]
    return out


def plain_counts(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    return len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t)), len(t)


@pytest.mark.parametrize(("step", "collide"), [(1 << 20, False), (64, False), (1000, False), (1 << 20, True), (64, True)])
def test_counts_by_plain_loops(monkeypatch, step, collide):
    monkeypatch.setattr(filter_audit, "STEP", step)
    if collide:  # few hashes: other words with the same one must still be told apart
        monkeypatch.setattr(filter_audit, "span_hashes", lambda data, start, end: ((end - start) % 3).astype(np.uint64))
    texts = pa.array([t or "" for t in odd_texts()]).cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    got = filter_audit.counts(np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64)[: len(texts) + 1])
    if not collide:
        assert [tuple(r) for r in got.tolist()] == [plain_counts(t) for t in odd_texts()]
    else:
        assert [r[1] for r in got.tolist()] == [plain_counts(t)[1] for t in odd_texts()]


def test_audit_by_plain_loops(spark):
    common.prepare(spark)
    rows = [(i if i != 5 else None, t, ["s", None, "t"][i % 3], "k", 1) for i, t in enumerate(odd_texts())] + [(9, "one two one", "s", "k", 1)]
    said = [(i, q, x) for i, (q, x) in enumerate([(1, 0), (0, 1), (None, 1), (1, None)] * 6)] + [(0, 0, 1), (None, 1, 1), (3, 7, 7)]
    got = filter_audit.audit(spark.createDataFrame(rows, "doc_id long, text string, source string, mask string, n int").repartition(3), spark.createDataFrame(said, "doc_id long, quality int, toxic int"))
    good, bad = ({d for d, q, x in said if d is not None and (q, x)[k] == 1} for k in (0, 1))
    docs = []
    for d, t, s, *_ in rows:
        w, distinct, capitals, symbols, points = plain_counts(t)
        copy = d is not None and any(o is not None and o < d and (u or "") == (t or "") for o, u, *_ in rows)
        docs.append((s or "", {"A": w < 200, "B": 100 * distinct < 50 * w, "C": 100 * capitals > 2 * points, "D": symbols > 0, "E": copy}, d in good, d in bad))
    want, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for k, f in enumerate(order):
            for part in {x[0] for x in docs}:
                own = [x for x in docs if x[0] == part]
                left = [x for x in own if not any(x[1][g] for g in order[:k])]
                gone = [x for x in left if x[1][f]]
                shapley[part, f] += len(gone)
                want[part, "".join(order), k + 1] = [len(left) - len(gone), len(gone), sum(x[1][f] for x in own) - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    assert {tuple(r)[:3]: [*tuple(r)[3:]] for r in got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()} == {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in want.items()}
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# ---- Toxicity -------------------------------------------------------------------------------------


def test_ftrl_by_plain_loops():
    rnd = random.Random(3)
    rows = [(y := rnd.randrange(2), sorted({rnd.randrange(10) + 5 * y for _ in range(4)})) for _ in range(60)]
    model = toxicity.Ftrl(0.7, 16)
    z, n = [0.0] * 17, [0.0] * 17
    weight = lambda i: 0.0 if abs(z[i]) <= (0 if i == 16 else 0.7) else -(z[i] - math.copysign(0 if i == 16 else 0.7, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    for y, at in rows:
        model.learn(np.array(at), y, 1.5)
        w = {i: weight(i) for i in [*at, 16]}
        g = 1.5 * (1 / (1 + math.exp(-sum(w.values()))) - y)
        for i, x in w.items():
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * x
            n[i] += g * g
    assert np.allclose(model.weights(np.arange(17)), [weight(i) for i in range(17)])
    assert (model.weights(np.arange(16)) == 0).any()  # L1 keeps some at zero


def test_slots_are_words_and_pairs_within_a_text():
    one, of = toxicity.slots(["a b, c", None or "", "A b", "c"])
    by = [set(one[of == k].tolist()) for k in range(4)]
    assert [len(x) for x in by] == [6, 0, 3, 1] and by[2] <= by[0] and by[3] <= by[0]  # a, b, c, a b, b c, a _ c


def test_toxic_documents_are_found(spark):
    """Held-out documents of sf0.1: nearly all clean ones stay, most toxic ones are found."""
    sf = "/root/testdata/sf0.1"
    got = queries.op12_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n.get((0, 1), 0) <= 0.005 * n[0, 0] and n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0))


def test_toxicity_of_odd_tables(spark):
    common.prepare(spark)
    kind = "doc_id long, text string, slots string, label int"
    rows = [(i, f"you {['idiot', 'friend'][i % 2]} w{i}", "s", 5) for i in range(80)] + [(200, None, "s", 1), (201, "", "s", 1), (None, "idiot", "s", 1), (202, "an IDIOT!", "s", 1), (203, "a friend", "s", 1), (3, "you friend", "s", 1)]
    docs = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(70)] + [(70, 0), (70, 1), (None, 1), (71, 7), (72, None), (5, 0)], "doc_id long, toxic int")
    got = {(r["doc_id"], r["score"], r["predicted"]) for r in toxicity.toxicity(docs, toxicity.learn(docs, labels)).collect()}
    by = {d: (s, p) for d, s, p in got}
    assert by[202][1] == by[None][1] == by[70][1] == 1 and by[203][1] == by[3][1] == 0 and by[200] == by[201] and all(0 <= s <= 1 for s, _ in by.values())
    for told, want in (([], 0), ([(1, 1)], 1), ([(1, 0)], 0), ([(999, 0), (998, 1)], 0)):
        model = toxicity.learn(docs, spark.createDataFrame(told, "doc_id long, toxic int"))
        assert {r["predicted"] for r in toxicity.toxicity(docs, model).collect()} == {want}
    assert toxicity.toxicity(spark.createDataFrame([], kind), model).count() == 0


def test_the_fold_is_not_learned_from(spark):
    ids = spark.range(1000).withColumn("out", langid.held_out(F.col("id"))).collect()
    assert {r["id"] for r in ids if r["out"]} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_a_probe_has_one_row_for_all_kinds(spark):
    """Else the join of ancestors and nodes grows with the kinds that are active together, which a busy client has all of."""
    common.prepare(spark)
    kinds = [time_tree.CLICKS, time_tree.SALES, time_tree.LINES, time_tree.ITEMS, time_tree.LATER]
    rows = [(1, k, lo, lo + 4, lo + 9, 1, 1, 1, None) for k in kinds for lo in range(8)]
    intervals = spark.createDataFrame(rows, "client long, kind int, lo long, mid long, hi long, n long, p long, c long, x decimal(38,0)")
    probes = spark.createDataFrame([(1, t) for t in range(12)], "client long, t long")
    for bucket in (2, 64):
        with common.scratch():
            got = {r["t"]: r for r in time_tree.active(intervals, probes, 16, bucket).collect()}
            assert time_tree.active(intervals, probes, 16, bucket).count() == 12 == len(got)
        for t in range(12):
            assert got[t]["label"] and got[t]["n_sales_1"] == sum(lo <= t < lo + 9 for lo in range(8))
            assert (got[t]["n_clicks_0"] or 0) == sum(lo <= t < lo + 4 for lo in range(8))
