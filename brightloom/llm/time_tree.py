"""A point-in-time feature table from a dyadic tree over time.

A probe is a client and a time. Each event of that client is active from the time that it is known until its window ends.
The tree's nodes are the aligned stretches of 2^k time units. An active interval is split into its canonical nodes, the
fewest that cover it; events are summed for each client and node; a probe explodes to its ancestors, and an equi-join on
client and node brings it the sums of all that is active, since each interval has one node at most above a probe.

A stretch of a client with BUCKET probes at most is a leaf. Below it the tree goes on over the places of its probes in time
order instead of time itself: an interval that reaches into the leaf covers a run of places, and has the canonical nodes of
that run. So an interval has few rows where probes are rare, and at most two for each level where they are dense. The first stretches are as long as the longest window. One that holds more probes is split as many levels down as
their number asks for; stretches there that still hold too many go into another round, where the sums of their ancestors
count as one interval that covers them. A client with a third of all rows thus spreads over its stretches.

Distinct items: of the active intervals of one client and item, each keeps what those that started before it leave free.
The parts are disjoint, so a probe meets one node at most for each item, and the nodes' counts add up to the distinct number.

The unit is the coarsest of a second, a millisecond and a microsecond that all probes are multiples of. Ends of intervals are
rounded up to it, which changes no comparison with a probe.

Defined results: rows without client or time are no probes and no events; nor are events that never arrive or, for lines,
that weren't shipped. A null sale_id counts as an empty text for the time's shift and has no lines. Null amounts are 0, as
are those that aren't finite. A null click_id comes last among clicks of one time. Fully equal clicks count once; sales that
repeat count each time and give a row each. Other columns matter only for the equality of clicks. Times are read as UTC.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, prepare, scratch, stored

#: Probes of a stretch whose tree is one over their places, and the least number of levels that one is split into at once.
BUCKET, DOWN = 64, 6
DAY, MINUTE = 86_400_000_000, 60_000_000
#: Kinds of intervals. Of distinct items some count in both windows, some in one.
CLICKS, SALES, LINES, ITEMS, ITEMS_SHORT, ITEMS_LONG, LATER = range(7)
#: Packs (time, id) into one decimal; ids are within 2^63 of 0, and null is below all.
_PLACE, _NO_ID = Decimal(20_000_000_000_000_000_000), Decimal(-9_300_000_000_000_000_000)


def micros(column: Column) -> Column:
    """Microseconds since 1970 of a time without a zone; the session's zone doesn't matter."""
    c = column.cast("timestamp_ntz")
    second = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(c.cast("date")).cast("long") * DAY + (F.hour(c) * 60 + F.minute(c)).cast("long") * MINUTE + second


def cents(column: Column) -> Column:
    """floor(100 * x + 0.5); 0 for null and for what isn't finite or is over 10^15."""
    x = column.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) > 1e15), F.lit(0)).otherwise(F.coalesce(F.floor(x * 100 + 0.5), F.lit(0))).cast("long")


def _ceiled(x: Column, unit: int) -> Column:
    """The first unit that doesn't start before x microseconds."""
    return F.call_function("div", x + F.pmod(-x, F.lit(unit)), F.lit(unit)) if unit > 1 else x


def _packed(time: Column, number: Column) -> Column:
    return (time.cast("decimal(19,0)") * F.lit(_PLACE)).cast("decimal(38,0)") + F.coalesce(number.cast("decimal(19,0)"), F.lit(_NO_ID))


def _number_of(packed: Column) -> Column:
    """The id of a packed pair; null for a null id."""
    rest = F.pmod((packed + F.lit(_PLACE / 2)).cast("decimal(38,0)"), F.lit(_PLACE)) - F.lit(_PLACE / 2)
    return F.when(rest > F.lit(_NO_ID), rest.cast("long"))


def _sums() -> list[Column]:
    return [*(F.sum(c).alias(c) for c in ("n", "p", "c")), F.max("x").alias("x")]


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "kind", "short").agg(*_sums())


def _cut(pieces: DataFrame) -> DataFrame:
    """Intervals (lo, mid, hi) clipped to their stretch, which is the cell at the level."""
    lo, hi = F.greatest("lo", F.expr("shiftleft(cell, level)")), F.least("hi", F.expr("shiftleft(cell + 1, level)"))
    return pieces.withColumns({"lo": lo, "hi": hi, "mid": F.least(F.greatest("mid", lo), hi)})


def _cells(level: int) -> list[Column]:
    """A row for each stretch that [lo, hi) reaches into."""
    return [F.lit(level).alias("level"), F.explode(F.expr(f"sequence(shiftright(lo, {level}), shiftright(hi - 1, {level}))")).alias("cell")]


def active(intervals: DataFrame, probes: DataFrame, span: int, bucket: int = BUCKET, read: Sequence[DataFrame] = ()) -> DataFrame:
    """(client, t, label, measures): a row for each probe (client, t) at which anything is active.

    Intervals are (client, lo, mid, hi, kind, n, p, c, x), at most span long. short: t lies in [lo, mid), else in [mid, hi).
    n, p and c are added up; of x the largest counts. Whole numbers of time units. Intermediate tables are stored, and go when
    nothing reads them any more, as do those of `read`, which only the intervals come from.

    Spark's tasks send the driver the metrics of all operators below an aggregate or a sort, up to the tables that are scanned.
    Intervals and nodes are stored so that no plan is deep, and what a task sends stays near what Spark's tasks send anyway.
    """
    top, at = (span - 1).bit_length(), ["client", "level", "cell"]
    intervals = _swept(intervals.where("lo < hi"), "intervals", read)
    pieces = _cut(intervals.select("*", *_cells(top)))
    probes = probes.select("client", "t", F.lit(top).alias("level"), F.shiftright("t", top).alias("cell"))
    found, last = [], [intervals]
    while True:
        held = probes.groupBy(at).agg(F.count("*").alias("held"))
        # so many levels down that a stretch has about a quarter of a bucket to half of it, were the probes spread evenly;
        # as they aren't, a few levels more save most stretches another round
        down = F.least("level", F.greatest(F.lit(DOWN), F.ceil(F.log2(F.col("held") / bucket)).cast("int") + 1))
        held = stored(held.select(*at, F.when(F.col("held") > bucket, F.col("level") - down).alias("below")), "cells")
        dense = held.where("below is not null")
        probes = now = stored(probes.join(held.hint("merge"), at), "probes")
        leaves = probes.where("below is null").groupBy(at).agg(F.sort_array(F.collect_list("t")).alias("ts")).withColumn("top", F.ceil(F.log2(F.size("ts"))).cast("int"))
        within = _within(pieces, leaves)
        if dense.isEmpty():
            nodes = _swept(within, "nodes", last)
            found.append(_swept(_met(leaves, nodes), "active", [nodes, now]))
            return reduce(DataFrame.unionByName, found)
        # one pass over the shuffled intervals gives both the sums of leaves and the intervals that go on
        rest = pieces.join(dense.hint("merge"), at).select(*at, "below", "kind", "n", "p", "c", "x", "lo", "mid", "hi")
        both = _swept(within.unionByName(rest, allowMissingColumns=True), "nodes", last)
        found.append(_swept(_met(leaves, both.where("node is not null").select(*within.columns)), "active"))
        split = both.where("node is null").select(*rest.columns).withColumnRenamed("level", "top")
        nodes = _summed(_canonical(split), "client", "level", "node")
        # probes of one stretch of the lowest level have the same ancestors
        probes = probes.where("below is not null").select("client", "t", F.col("level").alias("top"), F.col("below"), F.expr("shiftright(t, below)").alias("cell"))
        inner = probes.select("client", "top", "below", "cell").distinct().select("client", "below", "cell", F.explode(F.sequence("below", "top")).alias("level"))
        above = inner.withColumn("node", F.expr("shiftright(cell, level - below)"))
        summed = _swept(_summed(above.join(nodes.hint("merge"), ["client", "level", "node"]), "client", "below", "cell"), "nodes")
        sums = summed.withColumnRenamed("below", "level")
        start, end = F.expr("shiftleft(cell, level)"), F.expr("shiftleft(cell + 1, level)")
        covering = sums.select("*", start.alias("lo"), F.when(F.col("short"), end).otherwise(start).alias("mid"), end.alias("hi")).drop("short")
        ends = [F.expr(f"if(shiftleft(shiftright({e}, below), below) <> {e}, shiftright({e}, below), null)") for e in ("lo", "mid", "hi")]
        edges = split.withColumn("cell", F.explode(F.array_distinct(F.array(*ends)))).where("cell is not null").withColumnRenamed("below", "level")
        # ends at one time, as of lines shipped on one day or of one sale, are added up before they are dealt out
        same = _cut(edges).where("lo < hi").groupBy(*at, "lo", "mid", "hi", "kind").agg(*_sums())
        pieces = _swept(same.unionByName(covering), "pieces", [held, summed, both])
        last = [pieces, now]
        probes = probes.select("client", "t", F.col("below").alias("level"), "cell")


def _swept(df: DataFrame, name: str, read: Sequence[DataFrame] = ()) -> DataFrame:
    """Stores the rows and deletes the tables that they alone were still to be read for. Spark deletes shuffle files once the
    driver has collected their garbage, which is long after if its heap is large; so it is told to."""
    out = stored(df, name)
    discard(*read)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def _within(pieces: DataFrame, leaves: DataFrame) -> DataFrame:
    """The trees' nodes (leaf, level, node, label, measures) of what is active within the leaves (client, level, cell, ts, top); ts are
    the times of a leaf's probes, BUCKET at most. A node has all its kinds in one row, so a probe meets a row for each level at most."""
    at, ends = ["client", "level", "cell"], ("lo", "mid", "hi")
    places = pieces.join(leaves.hint("merge"), at).withColumns({e: F.expr(f"size(filter(ts, t -> t < {e}))") for e in ends}).where("lo < hi")
    # places after the last probe are all the same, so what reaches there ends with the tree
    places = places.withColumns({e: F.expr(f"if({e} = size(ts), shiftleft(1, top), {e})") for e in ends})
    split = places.select(F.struct(*at).alias("client"), "top", F.lit(0).alias("below"), *ends, "kind", "n", "p", "c", "x")
    return _features(_canonical(split), "client", "level", "node").withColumnRenamed("client", "leaf")


def _met(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(client, t, label, measures): the sums of the nodes above each probe of the leaves."""
    probes = leaves.select(F.struct("client", "level", "cell").alias("leaf"), "top", F.posexplode("ts").alias("place", "t")).select("leaf", "t", "place", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level"))
    met = probes.withColumn("node", F.expr("shiftright(place, level)")).join(nodes.hint("merge"), ["leaf", "level", "node"])
    return met.groupBy(F.col("leaf.client").alias("client"), "t").agg(F.max("label").alias("label"), *(_add(m)(m).alias(m) for m in _MEASURED))


def _canonical(split: DataFrame) -> DataFrame:
    """The canonical nodes of both parts of an interval, between the levels below and top, with the intervals' measures.

    Parts that begin and end in the same stretches of the lowest level have the same nodes, and are added up first.
    """
    parts = F.explode(F.array(*(F.struct(F.lit(short).alias("short"), F.expr(f"shiftright({a} - 1, below) + 1").alias("l"), F.expr(f"shiftright({b}, below)").alias("r")) for short, a, b in ((True, "lo", "mid"), (False, "mid", "hi"))))).alias("part")
    whole = split.select("client", "below", "top", "kind", "n", "p", "c", "x", parts).where("part.l < part.r").withColumns({k: F.col(f"part.{k}") for k in ("short", "l", "r")})
    whole = _summed(whole, "client", "below", "top", "l", "r")
    each = whole.select("*", F.explode(F.sequence("below", "top")).alias("level"))
    each = each.withColumns({"l": F.expr("shiftright(l - 1, level - below) + 1"), "r": F.expr("shiftright(r, level - below)")}).where("l < r")
    nodes = F.explode(F.array(F.expr("if(level = top or l % 2 <> 0, l, null)"), F.expr("if(level < top and r % 2 <> 0, r - 1, null)"))).alias("node")
    return each.select("client", "level", nodes, "kind", "short", "n", "p", "c", "x").where("node is not null")


def _interval(kind: int | Column, lo: Column, mid: Column, hi: Column, n: Column, p: Column | None = None, c: Column | None = None, x: Column | None = None) -> list[Column]:
    zero = F.lit(0).cast("long")
    cols = {"lo": F.least(lo, hi), "mid": F.greatest(F.least(lo, hi), F.least(mid, hi)), "hi": hi, "kind": kind if isinstance(kind, Column) else F.lit(kind), "n": n.cast("long"), "p": zero if p is None else p, "c": zero if c is None else c, "x": F.lit(None).cast("decimal(38,0)") if x is None else x}
    return [F.col("client"), *(v.alias(k) for k, v in cols.items())]


def _items(lines: DataFrame, level: int) -> DataFrame:
    """Intervals of distinct items: within stretches, of those of one client and item each keeps what earlier ones leave free.

    Where the windows' free parts start together, one interval stands for both.
    """
    parts = lines.where("item is not null").select("client", "item", "lo", "mid", "hi", *_cells(level))
    # one row for each start, so a client's item has no more rows in a stretch than that has time units
    parts = _cut(parts).groupBy("client", "item", "cell", "lo").agg(F.max("mid").alias("mid"), F.max("hi").alias("hi"))
    before = Window.partitionBy("client", "item", "cell").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    free = parts.select("client", "mid", "hi", F.greatest("lo", F.max("mid").over(before)).alias("short_lo"), F.greatest("lo", F.max("hi").over(before)).alias("long_lo"))
    both = "short_lo = long_lo"
    kinds = [(ITEMS, both, "long_lo", "mid", "hi"), (ITEMS_SHORT, f"not ({both}) and short_lo < mid", "short_lo", "mid", "mid"), (ITEMS_LONG, f"not ({both}) and long_lo < hi", "long_lo", "long_lo", "hi")]
    some = F.explode(F.array(*(F.when(F.expr(cond), F.struct(F.lit(k).alias("kind"), *(F.col(c).alias(n) for c, n in ((lo, "lo"), (mid, "mid"), (hi, "hi"))))) for k, cond, lo, mid, hi in kinds)))
    rows = free.select("client", some.alias("r")).where("r is not null").select("client", "r.kind", "r.lo", "r.mid", "r.hi").where("lo < hi")
    return rows.select(*_interval(F.col("kind"), F.col("lo"), F.col("mid"), F.col("hi"), F.lit(1)))


def point_in_time(clicks: DataFrame, sales: DataFrame, lines: DataFrame, windows: tuple[int, int] = (2, 14), lag_minutes: int = 240, horizon: int = 7, spread: int = 259_200, bucket: int = BUCKET) -> DataFrame:
    """(sale_id, d, t_us, label, n_clicks, n_purchases, click_cents, last_click_id, n_sales, sale_cents, n_lines, n_items,
    line_cents) for each sale and window of d days, shorter one first.

    t_us is the sale's time and up to spread seconds more, by a hash of its number. Clicks, sales and lines of the client
    count if they happened in the d days up to then and were there lag_minutes before. label: the client buys within
    horizon days after it.
    """
    prepare(sales.sparkSession)
    short, long = (d * DAY for d in windows)
    lag = F.lit(lag_minutes * MINUTE)
    with scratch() as keep:
        number = F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")
        t = F.col("at") + F.pmod(F.crc32(number), F.lit(spread)) * 1_000_000
        told = sales.select("sale_id", F.col("client_id").alias("client"), micros(F.col("sold_at")).alias("at"), (micros(F.col("arrived_at")) + lag).alias("known"), cents(F.col("total")).alias("paid"))
        told = stored(told.where("client is not null and at is not null").withColumn("t_us", t), "sales")
        finest = told.select(*(F.coalesce(F.max(F.pmod("t_us", F.lit(u))), F.lit(0)) for u in (1_000_000, 1000))).first()
        unit = 1_000_000 if not finest[0] else 1000 if not finest[1] else 1
        in_units = lambda x: _ceiled(x, unit)
        at, known = F.col("at"), F.col("known")
        ends = [in_units(at + short), in_units(at + long)]
        last = (long + unit - 1) // unit

        seen = clicks.where(F.col("client_id").isNotNull() & F.col("ts").isNotNull() & F.col("arrived_at").isNotNull()).distinct()
        seen = seen.select(F.col("client_id").alias("client"), micros(F.col("ts")).alias("at"), (micros(F.col("arrived_at")) + lag).alias("known"), (F.col("kind") == "purchase").alias("bought"), cents(F.col("value")).alias("paid"), "click_id")
        start = in_units(F.greatest(at, known))
        own = seen.select(*_interval(CLICKS, start, *ends, F.lit(1), F.coalesce(F.col("bought").cast("long"), F.lit(0).cast("long")), F.col("paid"), _packed(at, F.col("click_id"))))
        sold = told.where("known is not null").select(*_interval(SALES, start, *ends, F.lit(1), c=F.col("paid")))
        later = told.select(*_interval(LATER, in_units(at - horizon * DAY), in_units(at), in_units(at), F.lit(1)))

        shipped = lines.where("sale_id is not null and shipped_at is not null").groupBy("sale_id", micros(F.col("shipped_at")).alias("shipped"), F.col("item_id").alias("item")).agg(F.count("*").alias("n"), F.sum(cents(F.col("amount"))).alias("paid"))
        of_sale = told.where("known is not null and sale_id is not null").select("sale_id", "client", "at", "known")
        bounds = {"lo": in_units(F.greatest(at, known, F.col("shipped"))), "mid": ends[0], "hi": ends[1]}
        rows = stored(shipped.join(of_sale.hint("merge"), "sale_id").select("client", "item", "n", "paid", *(v.alias(k) for k, v in bounds.items())).where("lo < hi"), "lines")
        put = rows.groupBy("client", "lo", "mid", "hi").agg(F.sum("n").alias("n"), F.sum("paid").alias("paid")).select(*_interval(LINES, F.col("lo"), F.col("mid"), F.col("hi"), F.col("n"), c=F.col("paid")))
        level = max(0, (last - 1).bit_length() - 2)
        items = _items(rows, level)

        probes = told.select("client", F.call_function("div", F.col("t_us"), F.lit(unit)).alias("t")).distinct()
        events = reduce(DataFrame.unionByName, [own, sold, later, put, items])
        most = max(last, (horizon * DAY + unit - 1) // unit + 1)
        features = active(events, probes, most, bucket, [rows])
        told = told.withColumns({"t": F.call_function("div", F.col("t_us"), F.lit(unit))})
        out = told.join(features.hint("merge"), ["client", "t"], "left").select("sale_id", "t_us", F.coalesce("label", F.lit(False)).alias("label"), F.explode(_by_window(windows)).alias("f"))
        return keep(stored(out.select("sale_id", "f.d", "t_us", "label", *(f"f.{m}" for m in MEASURES)), "features"))


#: Each measure: its column of the sums, its kinds of intervals; those that count for the shorter or the longer window only.
MEASURES = {"n_clicks": ("n", CLICKS), "n_purchases": ("p", CLICKS), "click_cents": ("c", CLICKS), "last_click_id": ("x", CLICKS), "n_sales": ("n", SALES), "sale_cents": ("c", SALES), "n_lines": ("n", LINES), "n_items": ("n", ITEMS), "line_cents": ("c", LINES)}
ALONE = {ITEMS: (ITEMS_SHORT, ITEMS_LONG)}


#: The measures of both windows, as columns.
_MEASURED = [f"{m}_{i}" for i in range(2) for m in MEASURES]


def _add(measured: str) -> Callable[[str], Column]:
    return F.max if MEASURES[measured[:-2]][0] == "x" else F.sum


def _features(sums: DataFrame, *keys: str) -> DataFrame:
    """Both windows' measures of rows (keys, kind, short, n, p, c, x)."""
    aggs = [(F.coalesce(F.max(F.col("kind") == LATER), F.lit(False))).alias("label")]
    for i in range(2):
        for m, (c, kind) in MEASURES.items():
            counts = F.col("kind") == kind
            counts = counts if i else counts & F.col("short")
            if kind in ALONE:
                counts |= F.col("kind") == ALONE[kind][i]
            aggs.append(_add(f"{m}_{i}")(F.when(counts, F.col(c))).alias(f"{m}_{i}"))
    return sums.groupBy(*keys).agg(*aggs)


def _by_window(windows: tuple[int, int]) -> Column:
    def cell(m: str, i: int) -> Column:
        x = F.col(f"{m}_{i}")
        return _number_of(x) if MEASURES[m][0] == "x" else F.coalesce(x, F.lit(0)).cast("long")

    return F.array(*(F.struct(F.lit(d).cast("int").alias("d"), *(cell(m, i).alias(m) for m in MEASURES)) for i, d in enumerate(windows)))
