"""Hypothesis tests: Spark aggregates, then a formula over a few numbers.

Each test returns one row: test, statistic, df, p, effect and n. Ranks come from the global rank
kernel, so no window runs over all rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import special as S
from tesserae.functions.scalar import clean
from tesserae.operators.kernels import global_ranks, group_quantiles, long_form
from tesserae.sources.written import written

SCHEMA = "test string, statistic double, df double, p double, effect double, n long"


def _row(spark, *rows) -> DataFrame:
    return spark.createDataFrame([(t, *[None if x is None else float(x) for x in v], int(n)) for t, *v, n in rows], SCHEMA)


def group_stats(df: DataFrame, group: str, measure: str) -> list:
    """(level, n, mean, var) of each group; one row a group to the driver."""
    m = clean(measure)
    x = df.where(F.col(group).isNotNull() & m.isNotNull())
    return x.groupBy(F.col(group).alias("level")).agg(F.count(m).alias("n"), F.avg(m).alias("mean"), F.var_samp(m).alias("var")).orderBy("level").collect()


def _anova(stats) -> tuple[float, float, float, float]:
    n, k = sum(s["n"] for s in stats), len(stats)
    grand = sum(s["n"] * s["mean"] for s in stats) / n
    between = sum(s["n"] * (s["mean"] - grand) ** 2 for s in stats)
    within = sum((s["n"] - 1) * (s["var"] or 0.0) for s in stats)
    f = (between / (k - 1)) / (within / (n - k))
    return f, k - 1, n - k, between / (between + within)


def anova(df: DataFrame, group: str, measure: str) -> DataFrame:
    stats = group_stats(df, group, measure)
    f, d1, d2, eta = _anova(stats)
    return _row(df.sparkSession, ("anova", f, d2, S.f_upper(f, d1, d2), eta, sum(s["n"] for s in stats)))


def levene_test(df: DataFrame, group: str, measure: str) -> DataFrame:
    """Brown-Forsythe: analysis of variance of distances from the groups' medians; effect: variance ratio."""
    m = clean(measure)
    x = df.where(F.col(group).isNotNull() & m.isNotNull()).select(F.col(group).alias("g"), m.alias("v"))
    mid = group_quantiles(x, ["g"], "v", [0.5]).select("g", F.col("q")[0].alias("mid"))
    away = x.join(mid, "g").select("g", F.abs(F.col("v") - F.col("mid")).alias("v"))
    f, d1, d2, _ = _anova(group_stats(away, "g", "v"))
    var = [s["var"] for s in group_stats(x, "g", "v")]
    return _row(df.sparkSession, ("levene", f, d2, S.f_upper(f, d1, d2), max(var) / min(var) if min(var) else None, x.count()))


def cohens_d(a, b) -> float:
    pooled = math.sqrt(((a["n"] - 1) * (a["var"] or 0.0) + (b["n"] - 1) * (b["var"] or 0.0)) / (a["n"] + b["n"] - 2))
    return (a["mean"] - b["mean"]) / pooled if pooled else 0.0


def _t(a, b, welch: bool) -> tuple[float, float]:
    """t and its degrees of freedom."""
    if welch:
        va, vb = (a["var"] or 0.0) / a["n"], (b["var"] or 0.0) / b["n"]
        parts = (va**2 / (a["n"] - 1) if va else 0.0) + (vb**2 / (b["n"] - 1) if vb else 0.0)
        se, dof = math.sqrt(va + vb), (va + vb) ** 2 / parts if parts else a["n"] + b["n"] - 2
    else:
        dof = a["n"] + b["n"] - 2
        pooled = ((a["n"] - 1) * (a["var"] or 0.0) + (b["n"] - 1) * (b["var"] or 0.0)) / dof
        se = math.sqrt(pooled * (1 / a["n"] + 1 / b["n"]))
    return (a["mean"] - b["mean"]) / se if se else 0.0, dof


def t_test(df: DataFrame, group: str, measure: str, welch: bool | None = None) -> DataFrame:
    """Two groups; Welch where variances differ (by Brown-Forsythe at 5 %) unless told."""
    a, b = group_stats(df, group, measure)
    if welch is None:
        welch = levene_test(df, group, measure).first()["p"] < 0.05
    t, dof = _t(a, b, welch)
    return _row(df.sparkSession, ("welch" if welch else "t", t, dof, S.t_two_sided(t, dof), cohens_d(a, b), a["n"] + b["n"]))


def mean_difference_ci(df: DataFrame, group: str, measure: str, level: float = 0.95) -> DataFrame:
    a, b = group_stats(df, group, measure)
    va, vb = a["var"] / a["n"], b["var"] / b["n"]
    dof = (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
    half, diff = S.t_quantile((1 + level) / 2, dof) * math.sqrt(va + vb), a["mean"] - b["mean"]
    return df.sparkSession.createDataFrame([(diff, diff - half, diff + half, dof)], "difference double, low double, high double, df double")


def confidence_interval(df: DataFrame, measure: str, level: float = 0.95) -> DataFrame:
    m = clean(measure)
    r = df.agg(F.count(m).alias("n"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("std")).first()
    half = S.t_quantile((1 + level) / 2, r["n"] - 1) * r["std"] / math.sqrt(r["n"])
    return df.sparkSession.createDataFrame([(r["n"], r["mean"], r["mean"] - half, r["mean"] + half)], "n long, mean double, low double, high double")


def paired_t_test(df: DataFrame, a: str, b: str) -> DataFrame:
    d = clean(a) - clean(b)
    r = df.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).first()
    t = r["m"] / (r["s"] / math.sqrt(r["n"])) if r["s"] else 0.0
    return _row(df.sparkSession, ("paired t", t, r["n"] - 1, S.t_two_sided(t, r["n"] - 1), r["m"] / r["s"] if r["s"] else 0.0, r["n"]))


def _rank_sums(df: DataFrame, group: str, measure: str):
    """(level, n, rank sum) of each group, n, and the sum of t**3 - t over ties."""
    x = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), clean(measure).alias("v")).where("v is not null")
    r = global_ranks(x, "v").select("v", "n", "rank")
    ties = r.agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n")), F.sum("n")).first()
    cells = x.groupBy("g", "v").agg(F.count(F.lit(1)).alias("k"))  # counted first: a common value is one row a group
    sums = cells.join(r, "v").groupBy("g").agg(F.sum("k").alias("n"), F.sum(F.col("rank") * F.col("k")).alias("r")).orderBy("g").collect()
    return sums, ties[1], ties[0]


def _mann_whitney(a, b, n: int, ties: float) -> tuple:
    n1, n2 = a["n"], b["n"]
    u = a["r"] - n1 * (n1 + 1) / 2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (abs(u - n1 * n2 / 2) - 0.5) / sd if sd else 0.0
    return "mann-whitney", u, None, min(1.0, 2 * (1 - S.normal_cdf(z))), 2 * u / (n1 * n2) - 1, n


def mann_whitney(df: DataFrame, group: str, measure: str) -> DataFrame:
    (a, b), n, ties = _rank_sums(df, group, measure)
    return _row(df.sparkSession, _mann_whitney(a, b, n, ties))


def _kruskal(sums, n: int, ties: float) -> tuple:
    h = 12 / (n * (n + 1)) * sum(s["r"] ** 2 / s["n"] for s in sums) - 3 * (n + 1)
    h = h / (1 - ties / (n**3 - n)) if ties < n**3 - n else 0.0
    k = len(sums)
    return "kruskal-wallis", h, k - 1, S.chi2_upper(h, k - 1), (h - k + 1) / (n - k), n


def kruskal_wallis(df: DataFrame, group: str, measure: str) -> DataFrame:
    return _row(df.sparkSession, _kruskal(*_rank_sums(df, group, measure)))


def wilcoxon_signed_rank(df: DataFrame, before: str, after: str) -> DataFrame:
    d = (clean(after) - clean(before)).alias("d")
    x = df.select(d).where("d is not null and d <> 0").select(F.abs("d").alias("v"), (F.col("d") > 0).alias("up"))
    r = global_ranks(x.select("v"), "v")
    cells = x.groupBy("v").agg(F.count_if("up").alias("up"), F.count(F.lit(1)).alias("k"))
    w = cells.join(r, "v").agg(F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum("k").alias("n"), F.sum(F.col("k").cast("double") ** 3 - F.col("k")).alias("ties")).first()
    n = w["n"]
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - w["ties"] / 48)
    z = (w["plus"] - n * (n + 1) / 4) / sd if sd else 0.0
    return _row(df.sparkSession, ("wilcoxon", w["plus"], None, 2 * (1 - S.normal_cdf(abs(z))), 4 * w["plus"] / (n * (n + 1)) - 1, n))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, expected) of the filled cells; the windows run over cells."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    wa, wb, w = Window.partitionBy("a"), Window.partitionBy("b"), Window.partitionBy()
    return c.withColumn("expected", F.sum("n").over(wa) * F.sum("n").over(wb) / F.sum("n").over(w))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence, with Yates' correction on 2 x 2; effect: Cramér's V. Empty cells count through the margins."""
    r = contingency(df, a, b).agg(F.sum(F.col("n") * F.col("n") / F.col("expected")).alias("q"), F.sum("n").alias("n"), F.count_distinct("a").alias("ra"), F.count_distinct("b").alias("rb"), F.count(F.lit(1)).alias("cells"), F.sum((F.greatest(F.abs(F.col("n") - F.col("expected")) - 0.5, F.lit(0.0)) ** 2) / F.col("expected")).alias("yates")).first()
    plain = r["q"] - r["n"]  # sum of (o - e)^2 / e over all cells
    stat = r["yates"] if r["ra"] == r["rb"] == r["cells"] / 2 == 2 else plain
    dof = (r["ra"] - 1) * (r["rb"] - 1)
    v = math.sqrt(plain / (r["n"] * max(1, min(r["ra"], r["rb"]) - 1)))
    return _row(df.sparkSession, ("chi-square", stat, dof, S.chi2_upper(stat, dof), v, r["n"]))


def fisher_exact(df: DataFrame, a: str, b: str) -> DataFrame:
    """2 x 2 exact: hypergeometric probabilities no greater than the observed one; statistic: odds ratio."""
    c = {(r["a"], r["b"]): r["n"] for r in contingency(df, a, b).collect()}
    la, lb = sorted({x for x, _ in c}), sorted({y for _, y in c})
    if len(la) != 2 or len(lb) != 2:
        raise ValueError("Fisher's test needs two levels on each side")
    w, x, y, z = (c.get((i, j), 0) for i in la for j in lb)
    n, r1, c1 = w + x + y + z, w + x, w + y

    def log_p(k):
        return sum(map(math.lgamma, (r1 + 1, n - r1 + 1, c1 + 1, n - c1 + 1))) - sum(map(math.lgamma, (n + 1, k + 1, r1 - k + 1, c1 - k + 1, n - r1 - c1 + k + 1)))

    own = log_p(w)
    ks = range(max(0, r1 + c1 - n), min(r1, c1) + 1)
    p = math.fsum(math.exp(q) for q in map(log_p, ks) if q <= own + 1e-9)
    return _row(df.sparkSession, ("fisher", w * z / (x * y) if x * y else None, None, min(1.0, p), None, n))


def normality_test(df: DataFrame, measure: str) -> DataFrame:
    """D'Agostino-Pearson, from skewness and kurtosis; effect: skewness."""
    m = clean(measure)
    r = df.agg(F.count(m).alias("n"), F.skewness(m).alias("s"), F.kurtosis(m).alias("k")).first()
    n, s, k = r["n"], r["s"], r["k"]
    if n < 8:
        raise ValueError("at least 8 values are needed")
    y = s * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    e = 3 * (n - 1) / (n + 1)
    v = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (k + 3 - e) / math.sqrt(v)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / b1**2))
    d = 1 + x * math.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs((1 - 2 / a) / d) ** (1 / 3), d)) / math.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return _row(df.sparkSession, ("dagostino-pearson", k2, 2, S.chi2_upper(k2, 2), s, n))


def correlation_test(df: DataFrame, a: str, b: str, method: str = "pearson") -> DataFrame:
    x = df.select(clean(a).alias("a"), clean(b).alias("b")).dropna()
    if method == "kendall":
        return _kendall(x)
    if method == "spearman":
        ra = global_ranks(x.select("a"), "a").select("a", F.col("rank").alias("ra"))
        rb = global_ranks(x.select("b"), "b").select("b", F.col("rank").alias("rb"))
        x = x.join(ra, "a").join(rb, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    r = x.agg(F.corr("a", "b").alias("r"), F.count(F.lit(1)).alias("n")).first()
    t = r["r"] * math.sqrt((r["n"] - 2) / max(1e-300, 1 - r["r"] ** 2))
    return _row(df.sparkSession, (method, r["r"], r["n"] - 2, S.t_two_sided(t, r["n"] - 2), r["r"] ** 2, r["n"]))


def concordance(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> int:
    """Concordant less discordant pairs of rows in different cells (a, b), n rows each; ties count nothing."""
    if not len(a):
        return 0
    order = np.lexsort((b, a))
    a, n = a[order], n[order].astype(np.int64)
    b = np.unique(b[order], return_inverse=True)[1]
    total = 0
    for bit in range(int(b.max()).bit_length()):  # the highest bit in which two values of b differ says which is greater
        at = np.argsort(b >> (bit + 1), kind="stable")
        group, one, w = b[at] >> (bit + 1), (b[at] >> bit & 1).astype(bool), n[at]
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(start, len(at)))
        for own, before, sign in ((one, ~one, 1), (~one, one, -1)):
            sums = np.concatenate(([0], np.cumsum(w * before)))
            total += sign * int((w * own * (sums[:-1] - np.repeat(sums[start], size))).sum())
    start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    rows, squares = np.add.reduceat(n, start), np.add.reduceat(n * n, start)
    return total - int(((rows * rows - squares) // 2).sum())  # rows alike in a were counted by b


#: Bits of a rank that one level of the Kendall count looks at; a group then has at most (2 ** DIGIT) ** 2 cells.
DIGIT = 10


def concordance_within(group: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> int:
    """concordance summed over groups, a and b being less than 2 ** DIGIT."""
    of = np.unique(group, return_inverse=True)[1].astype(np.int64) << DIGIT
    size = np.bincount(of >> DIGIT, n).astype(np.int64)  # rows of different groups count as concordant, all of them
    return concordance(of + a, of + b, n) - (int(size.sum()) ** 2 - int((size * size).sum())) // 2


def _kendall(x: DataFrame) -> DataFrame:
    """Exact tau-b, tie-corrected p. Values become the number of rows below them, written in digits of DIGIT bits.

    Two rows differ first in some digit of a and some digit of b. For each pair of digits, rows alike in
    all higher ones form a group, of which only a table of counts by these two digits is needed, so no
    group grows with the data, however often it is split.
    """
    ra, rb = (global_ranks(x.select(c), c).select(c, F.col("before").alias(f"{c}r")) for c in ("a", "b"))
    cells = written(x.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).join(ra, "a").join(rb, "b").select(F.col("ar").alias("a"), F.col("br").alias("b"), "n"))
    n = cells.agg(F.sum("n")).first()[0] or 0

    def run(batches):
        import pyarrow as pa

        kept = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("x", "y", "da", "db", "n")]
            if kept is not None:
                now = [np.concatenate(c) for c in zip(kept, now, strict=True)]
            if not len(now[0]):
                continue
            group = np.cumsum(np.concatenate(([0], (np.diff(now[0]) != 0) | (np.diff(now[1]) != 0))))
            cut = int(np.searchsorted(group, group[-1]))  # the last group can go on in the next batch
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array([str(concordance_within(group[:cut], *[c[:cut] for c in now[2:]]))])], names=["s"])
            kept = [c[cut:] for c in now]
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array([str(concordance_within(np.zeros(len(kept[0]), dtype=np.int64), *kept[2:]))])], names=["s"])

    levels, low = max(1, -(-max(n - 1, 1).bit_length() // DIGIT)), (1 << DIGIT) - 1
    s = 0
    for i in range(levels):
        for j in range(levels):
            up = [F.shiftright("a", DIGIT * (i + 1)).alias("x"), F.shiftright("b", DIGIT * (j + 1)).alias("y")]
            digits = [F.shiftright(c, DIGIT * k).bitwiseAND(low).alias(f"d{c}") for c, k in (("a", i), ("b", j))]
            table = cells.select(*up, *digits, "n").groupBy("x", "y", "da", "db").agg(F.sum("n").alias("n"))
            rows = table.repartition("x", "y").sortWithinPartitions("x", "y")
            s += sum(int(r.s) for r in rows.mapInArrow(run, "s string").collect())  # a row for each batch
    ties = []
    for c in ("a", "b"):
        t = F.col("t").cast("double")
        got = cells.groupBy(c).agg(F.sum("n").alias("t")).agg(F.sum(t * (t - 1)), F.sum(t * (t - 1) * (t - 2)), F.sum(t * (t - 1) * (2 * t + 5))).first()
        ties.append([v or 0.0 for v in got])
    pairs = n * (n - 1)
    both = (pairs - ties[0][0]) * (pairs - ties[1][0])
    tau = 2 * s / math.sqrt(both) if both > 0 else None
    var = (pairs * (2 * n + 5) - ties[0][2] - ties[1][2]) / 18
    if n > 2:
        var += ties[0][0] * ties[1][0] / (2 * pairs) + ties[0][1] * ties[1][1] / (9 * pairs * (n - 2))
    p = 2 * (1 - S.normal_cdf(abs(s) / math.sqrt(var))) if var > 0 and tau is not None else None
    return _row(x.sparkSession, ("kendall", tau, None, p, tau * tau if tau is not None else None, n))


def multiple_comparison(tests: DataFrame, p: str = "p", key: str = "name") -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg over a table of tests (one row a test)."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    up = Window.orderBy(p, key)
    rank = F.row_number().over(up)
    x = tests.withColumn("_n", n).withColumn("_k", rank)
    holm = F.max((F.col("_n") - F.col("_k") + 1) * F.col(p)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    bh = F.min(F.col("_n") / F.col("_k") * F.col(p)).over(up.rowsBetween(0, Window.unboundedFollowing))
    one = F.lit(1.0)
    return x.select(key, p, F.least(F.col(p) * F.col("_n"), one).alias("bonferroni"), F.least(holm, one).alias("holm"), F.least(bh, one).alias("benjamini_hochberg"))


BATTERY = "variable string, levels long, n long, test string, statistic double, df double, p double, effect_name string, effect double, cross_test string, cross_statistic double, cross_p double"


def _level_ranks(x: DataFrame, categories: list[str]) -> dict[str, tuple[dict, int, float]]:
    """{category: (rank sums by level, n, ties)} of categories without gaps: the measure _m is ranked once for all of them."""
    cells = written(x.groupBy("_m", *categories).agg(F.count(F.lit(1)).alias("k")))  # a common value is a few rows
    ranks = global_ranks(cells.groupBy("_m").agg(F.sum("k").alias("k")).withColumnRenamed("_m", "v"), "v", weight="k").select(F.col("v").alias("_m"), "n", "rank")
    ranks = written(ranks)
    ties, n = ranks.agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n")), F.sum("n")).first()
    levels = F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in categories]))
    sums = cells.join(ranks.select("_m", "rank"), "_m").select("k", "rank", levels).groupBy("variable", "value").agg(F.sum("k").alias("n"), F.sum(F.col("rank") * F.col("k")).alias("r"))
    out: dict[str, tuple[dict, int, float]] = {c: ({}, n, ties) for c in categories}
    for r in sums.collect():  # at most 20 levels a category
        out[r.variable][0][r.value] = r
    return out


def battery(df: DataFrame, measure: str, categories: list[str], alpha: float = 0.05) -> DataFrame:
    """A measure against every category of 2 to 20 levels: t (Welch's where variances differ) or F, and beside it Mann-Whitney or Kruskal-Wallis.

    holm: p adjusted for the number of categories; significant after that; agrees: both tests are on one side
    of alpha; confidence: high, moderate or low. Group moments of all categories come from one aggregate;
    categories without gaps share one ranking of the measure, one with gaps ranks its own rows.
    """
    spark = df.sparkSession
    x = df.select(clean(measure).alias("_m"), *[F.col(c).cast("string").alias(c) for c in categories]).where("_m is not null")
    g = long_form(x, categories, "_m").where("value is not null").groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("_m").alias("mean"), F.var_samp("_m").alias("var"))
    g = written(g)
    used = g.groupBy("variable").agg(F.count(F.lit(1)).alias("levels"), F.sum("n").alias("n")).where("levels between 2 and 20 and n > levels")
    stats: dict[str, list] = {}
    for r in g.join(used.select("variable"), "variable").orderBy("variable", "value").collect():  # at most 20 levels a category
        stats.setdefault(r.variable, []).append(r)
    names = [c for c in categories if c in stats]
    if not names:
        return spark.createDataFrame([], BATTERY + ", holm double, significant boolean, agrees boolean, confidence string")
    rows = x.count()
    full = [c for c in names if sum(s.n for s in stats[c]) == rows]
    ranks = _level_ranks(x.select("_m", *full), full) if full else {}
    for c in set(names) - set(full):
        ranks |= _level_ranks(x.where(F.col(c).isNotNull()).select("_m", c), [c])
    two = [c for c in names if len(stats[c]) == 2]
    apart = {}
    if two:  # Brown-Forsythe: are the variances of the two groups alike?
        y = long_form(x, two, "_m").where("value is not null")
        mid = group_quantiles(y, ["variable", "value"], "_m", [0.5]).select("variable", "value", F.col("q")[0].alias("mid"))
        away = F.abs(F.col("_m") - F.col("mid"))
        got = y.join(mid, ["variable", "value"]).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"), F.avg(away).alias("mean"), F.var_samp(away).alias("var")).collect()
        for c in two:
            f, d1, d2, _ = _anova([r for r in got if r.variable == c])
            apart[c] = S.f_upper(f, d1, d2) < 0.05
    out = []
    for c in names:
        own, (sums, n, ties) = stats[c], ranks[c]
        k = len(own)
        if k == 2:
            a, b = own
            t, dof = _t(a, b, apart[c])
            first = ("welch" if apart[c] else "t", t, dof, S.t_two_sided(t, dof), "cohens_d", cohens_d(a, b))
            second = _mann_whitney(sums[a.value], sums[b.value], n, ties)[:4]
        else:
            f, d1, d2, eta = _anova(own)
            first = ("anova", f, d2, S.f_upper(f, d1, d2), "eta_squared", eta)
            second = _kruskal(list(sums.values()), n, ties)[:4]
        out.append((c, k, n, *first, second[0], second[1], second[3]))
    kinds = [f.split()[1] for f in BATTERY.split(", ")]
    got = spark.createDataFrame([tuple(float(v) if k == "double" else v for v, k in zip(r, kinds, strict=True)) for r in out], BATTERY)
    got = got.join(multiple_comparison(got, "p", "variable").select("variable", "holm"), "variable")
    agrees = (F.col("p") < alpha) == (F.col("cross_p") < alpha)
    got = got.withColumn("significant", F.col("holm") < alpha).withColumn("agrees", agrees)
    return got.withColumn("confidence", F.when(F.col("significant") & F.col("agrees"), "high").when(F.col("agrees"), "moderate").otherwise("low"))
