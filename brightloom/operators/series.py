"""Daily series (series_id, ds, value): gaps, a spine of days, differences, autocorrelation, unit roots, ARIMA fits and forecasts.

Windows are partitioned by series_id. ARIMA fits run TOGETHER series at a time, in NumPy over Arrow, as rows stream in order.

Defined results: one row for each day of a series is expected; of rows that repeat a day the order is that of their values. Rows
without a day or a value are left out, as days that are missing, but gaps() looks at days alone. A null series_id is a series. ARIMA fits skip
missing days, with the likelihood of those that are there; differences, autocorrelations, unit root tests and ar1_cls take the days that are there as neighbours. A series without variation has null autocorrelations, statistics and fits, and so has
one that is too short (LEAST days for a fit or a unit root test, 4 for the Dickey-Fuller statistic, 3 for an AR(1) by least squares). An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.session import shipped


#: Days of the shortest series that is fitted.
LEAST = 8
#: Series that are fitted together.
TOGETHER = 32
#: Fixed values of MacKinnon (1994), one variable, constant term: the statistic's range, and the polynomials that give the
#: normal quantile of the p-value up to TAU_STAR and beyond it.
TAU_LEAST, TAU_STAR, TAU_MOST = -18.83, -1.61, 2.74
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def _w(key: str = "series_id", ds: str = "ds") -> Window:
    return Window.partitionBy(key).orderBy(ds)


def _known(df: DataFrame) -> DataFrame:
    return shipped(df).where("ds is not null and value is not null")


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    """A series in order of days."""
    return pdf.sort_values(["ds", "value"])


def _fits(v: np.ndarray) -> bool:
    return len(v) >= LEAST and float(np.ptp(v)) > 0


def gaps(df: DataFrame) -> DataFrame:
    """(series_id, ds, next_ds): days after which the next day is missing."""
    return df.where("ds is not null").withColumn("next_ds", F.lead("ds").over(_w())).where(F.datediff("next_ds", "ds") != 1).select("series_id", "ds", "next_ds")


def spine(df: DataFrame) -> DataFrame:
    """(series_id, ds, value): a row for each day from a series' first to its last, with a null value where the day is missing.
    Days come from a series' two ends; of rows that repeat a day the smallest value stays."""
    known = _known(df).groupBy("series_id", F.col("ds").cast("date").alias("ds")).agg(F.min("value").alias("value"))
    days = known.groupBy("series_id").agg(F.min("ds").alias("a"), F.max("ds").alias("b")).select(F.col("series_id").alias("of"), F.explode(F.sequence("a", "b")).alias("day"))
    joined = days.join(known, F.col("of").eqNullSafe(F.col("series_id")) & (F.col("day") == F.col("ds")), "left")
    return joined.select(F.col("of").alias("series_id"), F.col("day").alias("ds"), "value")


def diff(df: DataFrame) -> DataFrame:
    return _known(df).withColumn("d", F.col("value") - F.lag("value").over(_w())).where("d is not null").select("series_id", "ds", "d")


def ordered_split(df: DataFrame, share: float = 0.75) -> DataFrame:
    """Adds n and is_train: the first floor(share * rows) days."""
    return _known(df).withColumns({"n": F.row_number().over(_w()), "size": F.count("*").over(Window.partitionBy("series_id"))}).withColumn("is_train", F.col("n") <= F.floor(F.col("size") * share))


def acf(df: DataFrame, lags: int = 20) -> DataFrame:
    """(series_id, lag, acf, band): biased denominators; Bartlett's 95% half-width."""
    c = _known(df).withColumn("c", F.col("value") - F.avg("value").over(Window.partitionBy("series_id")))
    c = c.select("series_id", "c", *[F.lag("c", k).over(_w()).alias(f"l{k}") for k in range(1, lags + 1)])
    sums = c.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(F.col("c") * F.col("c")).alias("c0"), *[F.sum(F.col("c") * F.col(f"l{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.coalesce(F.col(f"c{k}"), F.lit(0.0)), F.col("c0")).alias("acf")) for k in range(lags + 1)])
    out = sums.select("series_id", "n", F.explode(pairs).alias("p")).select("series_id", "n", "p.lag", "p.acf")
    before = Window.partitionBy("series_id").orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf")).otherwise(0.0)).over(before), F.lit(0.0))
    return out.withColumn("band", F.when(F.col("acf").isNull(), F.lit(None)).when(F.col("lag") == 0, 0.0).otherwise(1.959963984540054 * F.sqrt((1 + 2 * inner) / F.col("n")))).drop("n")


def durbin_levinson(r: list[float]) -> list[float]:
    """Partial autocorrelations from autocorrelations (lag 0 included)."""
    out, phi = [1.0], np.zeros(0)
    for k in range(1, len(r)):
        rest = 1 - float(phi @ np.array(r[1:k]))
        a = (r[k] - float(phi @ np.array(r[k - 1 : 0 : -1]))) / rest if rest else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        out.append(float(a))
    return out


def pacf(df: DataFrame, lags: int = 20) -> DataFrame:
    """(series_id, lag, pacf) by Yule-Walker; a group holds lags+1 numbers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        return pd.DataFrame({"series_id": pdf["series_id"], "lag": pdf["lag"], "pacf": durbin_levinson(pdf["acf"].tolist()) if pdf["acf"].notna().all() else np.nan}).replace({np.nan: None})

    kind = dict(df.dtypes)["series_id"]
    return acf(df, lags).select("series_id", "lag", "acf").groupBy("series_id").applyInPandas(run, f"series_id {kind}, lag int, pacf double")


def df_tstat(df: DataFrame) -> DataFrame:
    """(series_id, t): Dickey-Fuller statistic with a constant and no lagged difference."""
    x = _known(df).withColumn("x", F.lag("value").over(_w())).where("x is not null").withColumn("y", F.col("value") - F.col("x"))
    s = x.groupBy("series_id").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    spread = F.try_divide(F.try_divide(F.greatest(F.lit(0.0), F.col("syy") - F.col("b") * F.col("sxy")), F.col("n") - 2), F.col("sxx"))
    return s.select("series_id", F.when(F.col("n") > 2, F.try_divide(F.col("b"), F.sqrt(spread))).alias("t"))


def _regress(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(coefficients, residual sum of squares, t of the first coefficient)."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = float(((y - x @ beta) ** 2).sum())
    spread = rss / max(1, len(y) - x.shape[1]) * np.linalg.pinv(x.T @ x)[0, 0]
    return beta, rss, float(beta[0] / math.sqrt(spread)) if spread > 0 else 0.0


def adf_stat(v: np.ndarray) -> tuple[float, int]:
    """(statistic, lag): constant term, the lag of least AIC up to 12 (n/100)^(1/4), all lags compared on the same rows."""
    n = len(v)
    most = max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2))
    d = np.diff(v)

    def design(lag: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        return d[skip:], np.column_stack([v[skip:-1], *(d[skip - k : len(d) - k] for k in range(1, lag + 1)), np.ones(len(d) - skip)])

    best, at = math.inf, 0
    for lag in range(most + 1):
        y, x = design(lag, most)
        _, rss, _ = _regress(y, x)
        aic = len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * x.shape[1]
        if aic < best - 1e-12:
            best, at = aic, lag
    return _regress(*design(at, at))[2], at


def adf_pvalue(t: float) -> float:
    """The asymptotic p-value of a Dickey-Fuller statistic with a constant, by MacKinnon's (1994) approximation."""
    if t > TAU_MOST:
        return 1.0
    if t < TAU_LEAST:
        return 0.0
    z = sum(c * t**i for i, c in enumerate(TAU_SMALL if t <= TAU_STAR else TAU_LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf(df: DataFrame) -> DataFrame:
    """(series_id, stat, lag, pvalue)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = _sorted(pdf)["value"].to_numpy()
        t, lag = adf_stat(v) if _fits(v) else (None, None)
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "stat": [t], "lag": [lag], "pvalue": [None if t is None else adf_pvalue(t)]})

    return _known(df).groupBy("series_id").applyInPandas(run, f"series_id {dict(df.dtypes)['series_id']}, stat double, lag int, pvalue double")


def _filtered(y: np.ndarray, ar: np.ndarray, ma: np.ndarray, d: int, mean: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The Kalman filter of ARIMA(1,d,1) for many series (rows of y, NaN where a day is missing) and many parameters at once.

    (days, sum of squared scaled errors, sum of log variances, mean, the next days' state) for each series and parameter. The
    state is (level before the day, w of the day, what the day's error adds tomorrow). A missing day moves the state on without
    an error, so the likelihood is that of the days that are there. With d the first day that is there is given, and its
    level known. With mean, a second filter over ones gives the mean by least squares.
    """
    one = np.ones(np.broadcast_shapes(y[:, :1].shape, ar.shape))
    ar, ma, zero = ar * one, ma * one, 0 * one
    # variances and covariances of the state over sigma^2: those of a stationary w
    pww, pwu, puu, pll, plw, plu = (1 + 2 * ar * ma + ma * ma) / (1 - ar * ar), ma.copy(), ma * ma, zero.copy(), zero.copy(), zero.copy()
    a = [[zero.copy(), zero.copy(), zero.copy()] for _ in range(1 + mean)]  # states of the series and of ones
    n, logs = zero.copy(), zero.copy()
    sums = [[zero.copy() for _ in range(1 + mean)] for _ in range(1 + mean)]
    begun = np.zeros((len(y), 1), bool)
    for t in range(y.shape[1]):
        now = y[:, t : t + 1]
        there = ~np.isnan(now)
        if d:
            first = there & ~begun
            a[0][0] = np.where(first, now - a[0][1], a[0][0])  # the first day sets the level; its w isn't told by it
            pll, plw, plu = np.where(first, pww, pll), np.where(first, -pww, plw), np.where(first, -pwu, plu)
            seen = there & begun
            begun = begun | there
        else:
            seen = there
        # the day's value is w, and the level with d
        f = pww + (pll + 2 * plw if d else 0)
        cl, cw, cu = (pll + plw, plw + pww, plu + pwu) if d else (plw, pww, pwu)
        use = seen & (f > 0)
        f = np.where(use, f, 1.0)
        e = [np.where(use, v - (s[1] + s[0] if d else s[1]), 0.0) for v, s in zip((now, 1.0), a)]
        gl, gw, gu = (np.where(use, c / f, 0.0) for c in (cl, cw, cu))
        n, logs = n + use, logs + np.where(use, np.log(f), 0.0)
        for i in range(1 + mean):
            for j in range(i + 1):
                sums[i][j] = sums[i][j] + e[i] * e[j] / f
        pll, plw, plu, pww, pwu, puu = pll - gl * cl, plw - gl * cw, plu - gl * cu, pww - gw * cw, pwu - gw * cu, puu - gu * cu
        a = [[s[0] + gl * x, s[1] + gw * x, s[2] + gu * x] for s, x in zip(a, e)]
        # tomorrow: the level takes in w, w' = ar w + u + error, u' = ma error
        a = [[s[0] + s[1], ar * s[1] + s[2], zero] for s in a]
        if d:
            pll, plw = pll + 2 * plw + pww, ar * (plw + pww) + plu + pwu
            plu = zero
        pww, pwu, puu = ar * ar * pww + 2 * ar * pwu + puu + 1, ma, ma * ma
    m = sums[1][0] / np.where(sums[1][1] > 0, sums[1][1], 1.0) if mean else zero
    square = sums[0][0] - (2 * m * sums[1][0] - m * m * sums[1][1] if mean else 0.0)
    state = np.stack([a[0][i] - (m * a[1][i] if mean else 0.0) for i in range(2)] + [a[0][2]])
    return n, square, logs, m, state


def arima_fits(y: np.ndarray, p: int, d: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ar, ma, mean) of each row of y, whose missing days are NaN: exact maximum likelihood of ARIMA(p<=1, d<=1, q<=1), with a
    constant where d is 0, by a refined grid. All rows and grid points are filtered together."""
    at, width = np.zeros((len(y), 2)), 0.96
    for _ in range(9):
        axes = [np.clip(c[:, None] + np.linspace(-width, width, 9), -0.995, 0.995) if used else np.zeros((len(y), 1)) for c, used in zip(at.T, (p, q), strict=True)]
        ar, ma = np.repeat(axes[0], axes[1].shape[1], axis=1), np.tile(axes[1], (1, axes[0].shape[1]))
        n, square, logs, _, _ = _filtered(y, ar, ma, d, not d)
        best = (n * np.log(np.maximum(1e-300, square / np.maximum(1, n))) + logs).argmin(axis=1)
        at = np.stack([ar[np.arange(len(y)), best], ma[np.arange(len(y)), best]], axis=1)
        width /= 3
    return at[:, 0], at[:, 1], _filtered(y, at[:, :1], at[:, 1:], d, not d)[3][:, 0]


def arima_fit(v: np.ndarray, p: int, d: int, q: int) -> dict[str, float]:
    """The fit of one series, in which NaN is a missing day."""
    return dict(zip(("ar", "ma", "mean"), (float(x[0]) for x in arima_fits(v[None], p, d, q)), strict=True))


def arima_forecast(v: np.ndarray, fit: dict[str, float], d: int, steps: int) -> np.ndarray:
    """The means of the days after v, in which NaN is a missing day."""
    level, nxt = _filtered((v - fit["mean"])[None], np.array([[fit["ar"]]]), np.array([[fit["ma"]]]), d, False)[4][:2, 0, 0]
    out = fit["mean"] + nxt * fit["ar"] ** np.arange(steps)
    return level + np.cumsum(out) if d else out


def _series(parts: Iterator[pd.DataFrame]) -> Iterator[list[tuple[object, pd.Series, np.ndarray]]]:
    """Lists of up to TOGETHER series (id, days, values) from sorted rows; a series may span batches."""
    held, of = [], []

    def closed() -> tuple[object, pd.Series, np.ndarray]:
        whole = pd.concat(of)
        return whole["series_id"].iloc[0], whole["ds"], whole["value"].to_numpy(np.float64)

    for pdf in parts:
        starts = (pdf["series_id"] != pdf["series_id"].shift()) & ~(pdf["series_id"].isna() & pdf["series_id"].shift().isna())
        for _, some in pdf.groupby(starts.cumsum()) if len(pdf) else ():
            new, old = some["series_id"].iloc[0], of[0]["series_id"].iloc[0] if of else None
            if of and not (new == old or pd.isna(new) and pd.isna(old)):
                held.append(closed())
                of = []
                if len(held) == TOGETHER:
                    yield held
                    held = []
            of.append(some)
    if of:
        yield [*held, closed()]


def _in_order(df: DataFrame) -> DataFrame:
    """Known days, each series in one partition and in order."""
    return _known(df).select("series_id", F.col("ds").cast("date").alias("ds"), F.col("value").cast("double").alias("value")).repartition("series_id").sortWithinPartitions("series_id", "ds", "value")


def on_days(ds: pd.Series, v: np.ndarray) -> np.ndarray:
    """Values by day from the first to the last, NaN where a day is missing; of rows that repeat a day the smallest value."""
    at = (pd.to_datetime(ds) - pd.to_datetime(ds.iloc[0])).dt.days.to_numpy()
    out = np.full(at[-1] + 1, np.nan)
    out[at[::-1]] = v[::-1]
    return out


def _padded(days: list[np.ndarray]) -> np.ndarray:
    """One row for each series; days after the end are missing ones."""
    out = np.full((len(days), max(map(len, days))), np.nan)
    for i, v in enumerate(days):
        out[i, : len(v)] = v
    return out


def arima(df: DataFrame, p: int, d: int, q: int) -> DataFrame:
    """(series_id, ar, ma, mean) of each series. Missing days are skipped by the filter."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _series(parts):
            fit = [i for i, (_, _, v) in enumerate(some) if _fits(v)]
            out = pd.DataFrame({"series_id": [x[0] for x in some]}).assign(ar=np.nan, ma=np.nan, mean=np.nan)
            if fit:
                out.loc[fit, ["ar", "ma", "mean"]] = np.stack(arima_fits(_padded([on_days(*some[i][1:]) for i in fit]), p, d, q), axis=1)
            yield out.astype({"series_id": object}).replace({np.nan: None})

    return _in_order(df).mapInPandas(run, f"series_id {dict(df.dtypes)['series_id']}, ar double, ma double, mean double")


def arima_holdout(df: DataFrame, p: int, d: int, q: int, share: float = 0.75) -> DataFrame:
    """(series_id, ds, y_true, y_pred): fitted on the first share of the known days, forecast for the others by the calendar."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _series(parts):
            cut = [int(len(v) * share) for _, _, v in some]
            fit = [i for i, (_, _, v) in enumerate(some) if _fits(v[: cut[i]])]
            days = {i: on_days(some[i][1].iloc[: cut[i]], some[i][2][: cut[i]]) for i in fit}
            fits = dict(zip(fit, zip(*arima_fits(_padded(list(days.values())), p, d, q), strict=True), strict=True)) if fit else {}
            for i, (key, ds, v) in enumerate(some):
                rest, told = ds.iloc[cut[i] :], None
                if i in fits and len(rest):
                    ahead = (pd.to_datetime(rest) - pd.to_datetime(ds.iloc[cut[i] - 1])).dt.days.to_numpy()
                    told = arima_forecast(days[i], dict(zip(("ar", "ma", "mean"), map(float, fits[i]), strict=True)), d, int(ahead[-1]))[np.maximum(ahead - 1, 0)]
                yield pd.DataFrame({"series_id": pd.Series([key] * len(rest), dtype=object), "ds": rest.to_numpy(), "y_true": v[cut[i] :], "y_pred": told})

    return _in_order(df).mapInPandas(run, f"series_id {dict(df.dtypes)['series_id']}, ds date, y_true double, y_pred double")


def ar1_cls(df: DataFrame) -> DataFrame:
    """(series_id, phi, intercept) by least squares on the day before."""
    x = _known(df).withColumn("x", F.lag("value").over(_w()))
    return x.where("x is not null").groupBy("series_id").agg(F.regr_slope("value", "x").alias("phi"), F.regr_intercept("value", "x").alias("intercept"))


def ar1_forecast(df: DataFrame, steps: int) -> DataFrame:
    """(series_id, h, forecast): mu + phi^h (last - mu); a random walk with drift where phi is 1."""
    last = _known(df).groupBy("series_id").agg(F.max_by("value", "ds").alias("last"))
    mu = F.try_divide(F.col("intercept"), 1 - F.col("phi"))
    out = ar1_cls(df).withColumnRenamed("series_id", "_id").join(last, F.col("_id").eqNullSafe(F.col("series_id"))).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    drift = F.col("last") + F.col("h") * F.col("intercept")
    return out.select("series_id", "h", F.when(F.col("phi") == 1, drift).otherwise(mu + F.pow("phi", F.col("h")) * (F.col("last") - mu)).alias("forecast"))
