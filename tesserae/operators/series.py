"""Panels of time series: every operator works on all series at once, one window or group a key.

A panel has key, t and y, one row for each key and time (build_series makes it so).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalar import clean
from tesserae.functions.special import normal_cdf
from tesserae.operators.kernels import gram, group_quantiles


def build_series(df: DataFrame, key: str, t: str, y: str, unit: str | None = None) -> DataFrame:
    time = F.date_trunc(unit, t).cast("date") if unit else F.col(t)
    return df.where(F.col(t).isNotNull() & clean(y).isNotNull()).groupBy(F.col(key).alias("key"), time.alias("t")).agg(F.avg(clean(y)).alias("y"))


def numbered(s: DataFrame) -> DataFrame:
    return s.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("t")) - 1)


def series_trend(s: DataFrame) -> DataFrame:
    """Slope by position, correlation of ranks with time, total and relative change."""
    by_y = Window.partitionBy("key").orderBy("y")
    rank = F.rank().over(by_y) + (F.count(F.lit(1)).over(Window.partitionBy("key", "y")) - 1) / 2
    x = numbered(s).withColumn("r", rank)
    g = x.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "i").alias("slope"), F.corr("r", "i").alias("spearman"), F.min_by("y", "t").alias("first"), F.max_by("y", "t").alias("last"))
    return g.select("key", "n", "slope", "spearman", (F.col("last") - F.col("first")).alias("change"), F.try_divide(F.col("last") - F.col("first"), F.abs("first")).alias("relative_change"))


def series_gaps(s: DataFrame) -> DataFrame:
    """Typical spacing in days, gaps over 1.5 times that, the largest, periods expected."""
    w = Window.partitionBy("key").orderBy("t")
    x = s.withColumn("gap", F.datediff("t", F.lag("t").over(w)))
    mid = x.select("key").distinct().join(group_quantiles(x, ["key"], "gap", [0.5]).select("key", F.col("q")[0].alias("spacing")), "key", "left")
    g = x.join(mid, "key").groupBy("key", "spacing").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") > 1.5 * F.col("spacing")).alias("gaps"), F.max("gap").cast("long").alias("largest"), F.datediff(F.max("t"), F.min("t")).alias("span"))
    return g.select("key", "n", "spacing", "gaps", "largest", (F.floor(F.col("span") / F.col("spacing")) + 1).cast("long").alias("expected"))


def frequency_label(days):
    return F.when(days <= 1.5, "daily").when(days <= 8, "weekly").when(days <= 32, "monthly").when(days <= 95, "quarterly").otherwise("yearly")


def infer_frequency(s: DataFrame) -> DataFrame:
    g = series_gaps(s)
    return g.select("key", "spacing", frequency_label(F.col("spacing")).alias("frequency"), "expected", F.col("n").alias("actual"))


def autocorrelation(s: DataFrame, lags: int = 24) -> DataFrame:
    """Correlations at each lag from one pass of lagged products, and the 1.96 / sqrt(n) band."""
    w = Window.partitionBy("key").orderBy("t")
    every = Window.partitionBy("key")
    x = s.withColumn("d", F.col("y") - F.avg("y").over(every))
    x = x.withColumns({f"_{k}": F.lag("d", k).over(w) for k in range(1, lags + 1)})
    x = x.select("key", "d", F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_{k}").alias("b")) for k in range(1, lags + 1)])))
    g = x.groupBy("key", "lag").agg(F.sum(F.col("d") * F.col("b")).alias("c"), F.sum(F.col("d") * F.col("d")).alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") > F.col("lag"))
    r = F.try_divide("c", "v")
    return g.select("key", "lag", r.alias("r"), (F.abs(r) > 1.96 / F.sqrt("n")).alias("significant"))


def seasonal_period(s: DataFrame) -> DataFrame:
    """By spacing (daily 7, weekly 52, monthly 12, quarterly 4), else the best lag whose correlation is over 0.3."""
    by_gap = F.when(F.col("spacing") <= 1.5, 7).when((F.col("spacing") >= 6) & (F.col("spacing") <= 8), 52).when((F.col("spacing") >= 28) & (F.col("spacing") <= 32), 12).when((F.col("spacing") >= 88) & (F.col("spacing") <= 93), 4)
    best = autocorrelation(s).where("lag > 1 and r > 0.3").groupBy("key").agg(F.max_by("lag", "r").alias("by_acf"))
    g = series_gaps(s).select("key", by_gap.alias("p")).join(best, "key", "left")
    return g.select("key", F.coalesce("p", "by_acf", F.lit(1)).cast("int").alias("period"))


def detrended(s: DataFrame) -> DataFrame:
    x = numbered(s)
    line = x.groupBy("key").agg(F.regr_slope("y", "i").alias("a"), F.regr_intercept("y", "i").alias("b"))
    return x.join(line, "key").select("key", "t", "i", "y", (F.col("y") - F.col("a") * F.col("i") - F.col("b")).alias("d"))


def series_seasonality(s: DataFrame, period: int) -> DataFrame:
    """Strength and F of the positions in the season, after the trend; peak, trough, amplitude."""
    x = detrended(s).withColumn("pos", F.col("i") % period)
    g = x.groupBy("key", "pos").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("m"), F.var_pop("d").alias("v"))
    w = Window.partitionBy("key")
    g = g.withColumn("gm", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    a = g.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * (F.col("m") - F.col("gm")) ** 2).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.max_by("pos", "m").alias("peak"), F.min_by("pos", "m").alias("trough"), (F.max("m") - F.min("m")).alias("amplitude"))
    return a.select("key", (F.col("b") / (F.col("b") + F.col("w"))).alias("strength"), ((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("f"), "peak", "trough", "amplitude")


def decompose_series(s: DataFrame, period: int) -> DataFrame:
    """Classical: centred moving average, means of what is left by position, residual."""
    half = period // 2
    x = numbered(s)
    w = Window.partitionBy("key").orderBy("t")
    full = F.count(F.lit(1)).over(w.rowsBetween(-half, half)) == 2 * half + 1
    inner = F.sum("y").over(w.rowsBetween(-half, half))
    if period % 2 == 0:
        inner = inner - (F.lag("y", half).over(w) + F.lead("y", half).over(w)) / 2
    x = x.withColumn("trend", F.when(full, inner / period)).withColumn("pos", F.col("i") % period)
    by = Window.partitionBy("key", "pos")
    x = x.withColumn("raw", F.avg(F.col("y") - F.col("trend")).over(by))
    first = F.when(F.col("i") < period, F.col("raw"))
    x = x.withColumn("seasonal", F.col("raw") - F.avg(first).over(Window.partitionBy("key")))
    return x.select("key", "t", "y", "trend", "seasonal", (F.col("y") - F.col("trend") - F.col("seasonal")).alias("residual"))


def structural_break(s: DataFrame, least: int = 10) -> DataFrame:
    """The cut with the largest shift of means in pooled deviations, from running sums."""
    w = Window.partitionBy("key").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("key")
    y = F.col("y")
    x = s.select("key", "t", F.count(y).over(w).alias("n1"), F.sum(y).over(w).alias("s1"), F.sum(y * y).over(w).alias("q1"), F.count(y).over(every).alias("n"), F.sum(y).over(every).alias("s"), F.sum(y * y).over(every).alias("q"))
    n2 = F.col("n") - F.col("n1")
    x = x.withColumn("n2", n2).where((F.col("n1") >= least) & (F.col("n2") >= least))
    m1, m2 = F.col("s1") / F.col("n1"), (F.col("s") - F.col("s1")) / F.col("n2")
    v = (F.col("q1") - F.col("n1") * m1 * m1 + F.col("q") - F.col("q1") - F.col("n2") * m2 * m2) / (F.col("n") - 2)
    x = x.withColumn("shift", F.abs(m2 - m1) / F.sqrt(F.greatest(v, F.lit(1e-300)))).withColumn("position", F.col("n1")).withColumn("before", m1).withColumn("after", m2)
    best = x.groupBy("key").agg(F.max_by(F.struct("t", "position", "shift", "before", "after"), F.struct("shift", -F.col("position"))).alias("b"))
    return best.select("key", "b.*", (F.col("b.shift") >= 1).alias("flagged"))


# MacKinnon's approximation of the p-value of a unit root test with a constant (lower and upper
# polynomial in the statistic, where they meet, where they end), and the KPSS table for a level.
MACKINNON_LOW = (2.1659, 1.4412, 0.038269)
MACKINNON_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
MACKINNON_MEET, MACKINNON_LEAST, MACKINNON_MOST = -1.61, -18.83, 2.74
KPSS_TABLE = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def adf_p(statistic: float) -> float:
    if statistic > MACKINNON_MOST:
        return 1.0
    if statistic < MACKINNON_LEAST:
        return 0.0
    terms = MACKINNON_LOW if statistic <= MACKINNON_MEET else MACKINNON_HIGH
    return normal_cdf(sum(c * statistic**k for k, c in enumerate(terms)))


def kpss_p(statistic: float) -> float:
    """Between 0.01 and 0.10, the ends of the table."""
    return float(np.interp(statistic, *zip(*KPSS_TABLE, strict=True)))


class Stationarity:
    """What both tests need of one series, taken in piece by piece: sums of products and the last few values, however long it is."""

    def __init__(self, n: int, most_lags: int | None):
        self.n, self.seen = n, 0
        lags = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))
        self.lags = max(0, lags if most_lags is None else min(lags, most_lags))
        self.near = int(n ** (2 / 9))
        self.reach = min(n - 1, 2 * math.ceil(1.1447 * max(1, self.near) ** (2 / 3) * n ** (1 / 3)))
        self.gram = np.zeros((self.lags + 3, self.lags + 3))
        self.head = np.zeros(0)  # the first values, for rows that only shorter lags have
        self.tail = np.zeros(0)
        self.products, self.cum, self.cum2 = np.zeros(self.reach + 1), 0.0, 0.0

    def rows(self, e: np.ndarray, lags: int) -> np.ndarray:
        """(difference, level before, earlier differences, 1) of each place in e that has so many lags."""
        w = np.lib.stride_tricks.sliding_window_view(e, lags + 2) if len(e) >= lags + 2 else np.zeros((0, lags + 2))
        d = np.diff(w, axis=1)[:, ::-1]
        return np.column_stack((d[:, :1], w[:, -2:-1], d[:, 1:], np.ones(len(w))))

    def add(self, e: np.ndarray) -> None:
        """The next deviations from the series' mean."""
        if len(self.head) < self.lags + 1:
            self.head = np.concatenate((self.head, e[: self.lags + 1 - len(self.head)]))
        both = np.concatenate((self.tail[len(self.tail) - min(len(self.tail), self.lags + 1) :], e))
        z = self.rows(both, self.lags)
        self.gram += z.T @ z
        c = self.cum + np.cumsum(e)
        self.cum, self.cum2 = float(c[-1]), self.cum2 + float(c @ c)
        before = self.tail[max(0, len(self.tail) - self.reach) :]
        long = np.concatenate((before, e))
        for k in range(min(self.reach, len(long) - 1) + 1):
            own = long[max(len(before), k) :]
            self.products[k] += float(own @ long[max(len(before), k) - k : len(long) - k])
        self.tail = long[max(0, len(long) - max(self.reach, self.lags + 1)) :]
        self.seen += len(e)

    def _fit(self, g: np.ndarray, lags: int, count: int) -> tuple[float, float] | None:
        """(sum of squares, t of the level) with that many earlier differences."""
        use = [1, *range(2, 2 + lags), self.lags + 2]
        a, b = g[np.ix_(use, use)], g[use, 0]
        if count <= len(use) or np.linalg.matrix_rank(a) < len(use):
            return None
        beta = np.linalg.solve(a, b)
        rss = float(g[0, 0] - b @ beta)
        if rss <= 1e-12 * max(g[0, 0], 1e-300):
            return None
        return rss, float(beta[0] / math.sqrt(rss / (count - len(use)) * np.linalg.inv(a)[0, 0]))

    def adf(self) -> tuple[float | None, int | None]:
        """The statistic with the lag of least AIC, and that lag."""
        count = self.n - self.lags - 1
        if self.n < 10:
            return None, None
        best = None
        for lags in range(self.lags + 1):
            got = self._fit(self.gram, lags, count)
            if got is not None:
                aic = count * math.log(got[0] / count) + 2 * (lags + 2)
                if best is None or aic < best[0]:
                    best = (aic, lags)
        if best is None:
            return None, None
        lags = best[1]
        g = self.gram.copy()
        early = self.rows(self.head, lags)  # rows that the longest lag leaves out
        wide = np.zeros((len(early), self.lags + 3))
        wide[:, : lags + 2], wide[:, -1] = early[:, : lags + 2], 1.0
        g += wide.T @ wide
        got = self._fit(g, lags, self.n - lags - 1)
        return (got[1], lags) if got else (None, None)

    def kpss(self) -> tuple[float | None, int | None]:
        """The statistic, its lags chosen from the data (Hobijn, Franses and Ooms)."""
        n, p = self.n, self.products
        if n < 12 or p[0] <= 0:
            return None, None
        terms = p[1 : self.near + 1] / (n / 2)
        s0, s1 = p[0] / n + terms.sum(), float((np.arange(1, self.near + 1) * terms).sum())
        lags = min(self.reach, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))) if s0 else 0
        k = np.arange(1, lags + 1)
        var = (p[0] + 2 * float(((1 - k / (lags + 1)) * p[1 : lags + 1]).sum())) / n
        return (self.cum2 / n**2 / var, lags) if var > 0 else (None, None)


def series_stationarity(s: DataFrame, most_lags: int | None = None) -> DataFrame:
    """(key, n, adf, adf_lags, adf_p, kpss, kpss_lags, kpss_p, verdict) per key.

    Augmented Dickey-Fuller with a constant and the lag of least AIC, and KPSS for a level. A series is
    read in order and piece by piece; its sums of products are all that is kept. Missing values are left
    out. Too short or constant series have null statistics, which count as not rejecting a unit root, and as no stationarity.
    """
    x = s.where(F.col("y").isNotNull() & ~F.isnan("y"))
    every = x.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))
    x = x.join(every, "key").select("key", "t", "n", (F.col("y") - F.col("mean")).alias("e"))
    kind = s.schema["key"].dataType.simpleString()
    names = ["n", "adf", "adf_lags", "adf_p", "kpss", "kpss_lags", "kpss_p"]

    def run(batches):
        import pyarrow as pa

        own, now = None, None

        def out():
            adf, kpss = own.adf(), own.kpss()
            row = (own.n, adf[0], adf[1], None if adf[0] is None else adf_p(adf[0]), kpss[0], kpss[1], None if kpss[0] is None else kpss_p(kpss[0]))
            kinds = (pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64())
            return pa.RecordBatch.from_arrays([now, *[pa.array([v], k) for v, k in zip(row, kinds, strict=True)]], names=["key", *names])

        for batch in batches:
            keys, n, e = batch.column("key").to_pylist(), batch.column("n").to_pylist(), batch.column("e").to_numpy()
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if own is None or now[0].as_py() != keys[a]:
                    if own is not None:
                        yield out()
                    own, now = Stationarity(n[a], most_lags), batch.column("key").slice(a, 1)
                own.add(e[a:b])
        if own is not None:
            yield out()

    schema = f"key {kind}, n long, adf double, adf_lags int, adf_p double, kpss double, kpss_lags int, kpss_p double"
    got = x.repartition("key").sortWithinPartitions("key", "t").select("key", "n", "e").mapInArrow(run, schema)
    root, level = F.coalesce(F.col("adf_p") < 0.05, F.lit(False)), F.coalesce(F.col("kpss_p") >= 0.05, F.lit(False))
    verdict = F.when(root & level, "stationary").when(~root & ~level, "non-stationary").when(root, "trend-stationary").otherwise("difference-stationary")
    return got.withColumn("verdict", verdict)


def analyse_series(s: DataFrame, period: int) -> DataFrame:
    """Trend, gaps, season, break, stationarity, lags with autocorrelation beyond the band, and issues (break, missing periods, too short)."""
    base = series_trend(s).join(series_gaps(s).drop("n"), "key").join(series_seasonality(s, period), "key").join(structural_break(s).select("key", "shift", "flagged"), "key", "left")
    state = series_stationarity(s).select("key", "adf_p", "kpss_p", F.col("verdict").alias("stationarity"))
    lags = autocorrelation(s).where("significant").groupBy("key").agg(F.array_sort(F.collect_list("lag")).alias("significant_lags"))  # 24 at most
    got = base.join(state, "key", "left").join(lags, "key", "left").withColumn("significant_lags", F.coalesce("significant_lags", F.array().cast("array<int>")))
    issues = F.array(F.when(F.col("flagged"), "break"), F.when(F.col("expected") > F.col("n"), "missing periods"), F.when(F.col("n") < 24, "too short"))
    return got.withColumn("issues", F.array_compact(issues))


# ---------------------------------------------------------------- forecasts: key, step (1 to h), forecast


def _steps(df: DataFrame, h: int) -> DataFrame:
    return df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))


def forecast_naive(s: DataFrame, h: int, season: int = 1) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("t"))
    last = s.withColumn("k", F.row_number().over(w)).where(F.col("k") <= season)
    got = _steps(last.select("key", "k", "y"), h)
    return got.where((season - F.col("k")) == (F.col("step") - 1) % season).select("key", "step", F.col("y").alias("forecast"))


def forecast_drift(s: DataFrame, h: int) -> DataFrame:
    g = s.groupBy("key").agg(F.min_by("y", "t").alias("a"), F.max_by("y", "t").alias("b"), F.count(F.lit(1)).alias("n"))
    return _steps(g, h).select("key", "step", (F.col("b") + F.col("step") * (F.col("b") - F.col("a")) / (F.col("n") - 1)).alias("forecast"))


def forecast_moving_average(s: DataFrame, h: int, width: int = 3) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("t"))
    g = s.withColumn("k", F.row_number().over(w)).where(F.col("k") <= width).groupBy("key").agg(F.avg("y").alias("m"))
    return _steps(g, h).select("key", "step", F.col("m").alias("forecast"))


def _collected(s: DataFrame) -> DataFrame:
    """Each series as one array in order of time: bounded by its own length."""
    return s.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("ys"))


def forecast_ses(s: DataFrame, h: int, grid: int = 19) -> DataFrame:
    """Simple exponential smoothing; the constant with least squared one-step errors on a grid."""
    alphas = F.array(*[F.lit((i + 1) / (grid + 1)) for i in range(grid)])

    def fold(a):
        zero = F.struct(F.element_at("ys", 1).alias("l"), F.lit(0.0).alias("e"))
        return F.aggregate(F.slice("ys", 2, F.size("ys")), zero, lambda z, y: F.struct((z["l"] + a * (y - z["l"])).alias("l"), (z["e"] + (y - z["l"]) * (y - z["l"])).alias("e")), lambda z: F.struct(z["e"].alias("e"), a.alias("alpha"), z["l"].alias("l")))

    g = _collected(s).withColumn("b", F.array_min(F.transform(alphas, fold)))
    return _steps(g.select("key", "b"), h).select("key", "step", F.col("b.l").alias("forecast"), F.col("b.alpha").alias("alpha"))


def forecast_holt_winters(s: DataFrame, h: int, season: int | None = None) -> DataFrame:
    """Level, trend and (with season) additive seasonal terms, folded over each series; constants from a small grid."""
    consts = [0.1, 0.3, 0.6]
    combos = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(g).alias("g")) for a in consts for b in consts for g in (consts if season else [0.0])])
    m = season or 1
    g = _collected(s).where(F.size("ys") >= (2 * m if season else 3))
    mean = F.aggregate(F.slice("ys", 1, m), F.lit(0.0), lambda z, y: z + y) / m
    start = F.transform(F.slice("ys", 1, m), lambda y: y - mean) if season else F.array(F.lit(0.0))
    slope = (F.element_at("ys", m + 1) - F.element_at("ys", 1)) / m

    def fold(c):
        zero = F.struct(F.lit(0).alias("i"), (mean if season else F.element_at("ys", 1)).alias("l"), slope.alias("b"), start.alias("s"), F.lit(0.0).alias("e"))

        def move(z, y):
            seas = F.element_at(z["s"], 1)
            error = y - (z["l"] + z["b"] + seas)
            level = z["l"] + z["b"] + c["a"] * error
            trend = z["b"] + c["a"] * c["b"] * error
            ring = F.concat(F.slice(z["s"], 2, m), F.array(seas + c["g"] * (1 - c["a"]) * error)) if season else z["s"]
            return F.struct((z["i"] + 1).alias("i"), level.alias("l"), trend.alias("b"), ring.alias("s"), (z["e"] + error * error).alias("e"))

        body = F.slice("ys", m + 1, F.size("ys")) if season else F.slice("ys", 2, F.size("ys"))
        return F.aggregate(body, zero, move, lambda z: F.struct(z["e"].alias("e"), z["l"].alias("l"), z["b"].alias("b"), z["s"].alias("s")))

    got = g.withColumn("f", F.array_min(F.transform(combos, fold)))
    seas = F.element_at("f.s", ((F.col("step") - 1) % m + 1).cast("int"))
    return _steps(got.select("key", "f"), h).select("key", "step", (F.col("f.l") + F.col("step") * F.col("f.b") + seas).alias("forecast"))


def forecast_theta(s: DataFrame, h: int) -> DataFrame:
    """Smoothing plus half the slope of the line."""
    slope = numbered(s).groupBy("key").agg(F.regr_slope("y", "i").alias("a"))
    ses = forecast_ses(s, h)
    return ses.join(slope, "key").select("key", "step", (F.col("forecast") + F.col("step") * F.col("a") / 2).alias("forecast"))


METHODS = {"naive": forecast_naive, "drift": forecast_drift, "moving_average": forecast_moving_average, "ses": forecast_ses, "holt": forecast_holt_winters, "theta": forecast_theta}


def backtest(s: DataFrame, method: str, h: int, origins: int = 3, **options) -> DataFrame:
    """Rolling origins in one job: each (key, origin) is a series cut h, 2h, ... rows before its end."""
    w = Window.partitionBy("key").orderBy(F.desc("t"))
    x = s.withColumn("back", F.row_number().over(w) - 1).withColumn("origin", F.explode(F.sequence(F.lit(1), F.lit(origins))))
    cut = F.col("origin") * h
    both = F.struct("key", "origin")
    train = x.where(F.col("back") >= cut).select(both.alias("key"), "t", "y")
    test = x.where((F.col("back") < cut) & (F.col("back") >= cut - h)).select(both.alias("key"), (cut - F.col("back")).cast("int").alias("step"), "y")
    got = METHODS[method](train, h, **options).join(test, ["key", "step"])
    return got.select("key.key", "key.origin", "step", "y", "forecast")


def forecast_run(s: DataFrame, h: int, method: str = "drift", coverage: float = 0.9) -> DataFrame:
    """Forecasts with intervals from the absolute errors of a back-test, per key and over all steps.

    The half width is the conformal rank: the ceil((n + 1) coverage)-th least error, the greatest where there are too few.
    """
    tested = backtest(s, method, h).select("key", F.abs(F.col("y") - F.col("forecast")).alias("e")).where("e is not null")
    own = Window.partitionBy("key")  # the back-test's errors: origins times h a key
    ranked = tested.withColumn("i", F.row_number().over(own.orderBy("e"))).withColumn("n", F.count(F.lit(1)).over(own))
    width = ranked.where(F.col("i") == F.least(F.ceil((F.col("n") + 1) * coverage), F.col("n"))).select("key", F.col("e").alias("half"))
    got = METHODS[method](s, h).select("key", "step", "forecast").join(width, "key")
    return got.select("key", "step", "forecast", (F.col("forecast") - F.col("half")).alias("low"), (F.col("forecast") + F.col("half")).alias("high"))


def forecast_lagged_ml(s: DataFrame, h: int, lags: int = 3, model: str = "linear") -> DataFrame:
    """One model of all series on their lags; h steps, each from the ones before it."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    names = [f"lag_{k}" for k in range(1, lags + 1)]
    w = Window.partitionBy("key").orderBy("t")
    x = s.withColumns({f"lag_{k}": F.lag("y", k).over(w) for k in range(1, lags + 1)}).dropna(subset=names)
    make = VectorAssembler(inputCols=names, outputCol="features")
    kinds = {"linear": lambda: LinearRegression(labelCol="y", regParam=0.01), "forest": lambda: RandomForestRegressor(labelCol="y", seed=1), "boosting": lambda: GBTRegressor(labelCol="y", seed=1, maxIter=20)}
    fitted = kinds[model]().fit(make.transform(x))
    back = Window.partitionBy("key").orderBy(F.desc("t"))
    now = s.withColumn("k", F.row_number().over(back)).where(F.col("k") <= lags).groupBy("key").pivot("k", list(range(1, lags + 1))).agg(F.first("y"))
    now = now.toDF("key", *names)
    out = []
    for i in range(1, h + 1):
        got = fitted.transform(make.transform(now))
        out.append(got.select("key", F.lit(i).alias("step"), F.col("prediction").alias("forecast")))
        now = got.select("key", F.col("prediction").alias("lag_1"), *[F.col(f"lag_{k}").alias(f"lag_{k + 1}") for k in range(1, lags)])
    result = out[0]
    for o in out[1:]:
        result = result.unionAll(o)
    return result


def forecast_var(s: DataFrame, h: int, most: int = 4) -> DataFrame:
    """Vector autoregression of a few series; the order by AIC, from Gram matrices of the lagged table."""
    keys = [r[0] for r in s.select("key").distinct().orderBy("key").collect()]  # the series are the columns
    wide = s.groupBy("t").pivot("key", keys).agg(F.first("y")).dropna()
    names = [f"s{i}" for i in range(len(keys))]
    wide = wide.toDF("t", *names)
    w = Window.partitionBy(F.lit(0)).orderBy("t")  # one row a time, the length of one series
    lagged = wide.withColumns({f"{c}_{k}": F.lag(c, k).over(w) for c in names for k in range(1, most + 1)}).dropna()
    best = None
    for p in range(1, most + 1):
        cols = names + [f"{c}_{k}" for k in range(1, p + 1) for c in names]
        n, mean, g = gram(lagged, cols)
        q = len(names)
        b = np.linalg.lstsq(g[q:, q:], g[q:, :q], rcond=None)[0]
        resid = (g[:q, :q] - b.T @ g[q:, :q]) / n
        aic = np.linalg.slogdet(resid + 1e-12 * np.eye(q))[1] + 2 * p * q * q / n
        if best is None or aic < best[0]:
            best = (aic, p, b, mean)
    _, p, b, mean = best
    q = len(names)
    last = [np.array([r[c] for c in names], dtype=float) for r in wide.orderBy(F.desc("t")).limit(p).collect()]
    rows = []
    for i in range(1, h + 1):
        x = np.concatenate(last) - mean[q:]
        y = mean[:q] + x @ b
        rows += [(k, i, float(v)) for k, v in zip(keys, y, strict=True)]
        last = [y, *last][:p]
    return s.sparkSession.createDataFrame(rows, "key string, step int, forecast double")
