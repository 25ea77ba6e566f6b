"""Descriptive statistics of columns, groups and pairs of columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalar import clean, strength
from tesserae.functions.special import t_two_sided
from tesserae.operators.kernels import global_ranks, gram, group_quantiles, long_form, quantiles, safe_corr, value_counts


def sample_skew(n, g1):
    """Sample-corrected skewness from the population's."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(n, g2):
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row a column: counts, centre, spread, quartiles, shape. One aggregate for all moments, and the quantile kernel."""
    q = quantiles(df, cols, [0.25, 0.5, 0.75])
    what = [F.count, F.avg, F.stddev_samp, F.var_samp, F.min, F.max, F.skewness, F.kurtosis]
    row = df.agg(F.count(F.lit(1)), *[F.struct(*[f(clean(c)) for f in what]) for c in cols]).first()
    rows = [(c, row[0], *r, *(q[c] or [None] * 3)) for c, r in zip(cols, row[1:], strict=True) if row[0]]
    a = df.sparkSession.createDataFrame(rows, "variable string, rows long, n long, mean double, std double, variance double, min double, max double, g1 double, g2 double, q1 double, median double, q3 double")
    n = F.col("n").cast("double")
    return a.select(
        "variable", "n", (F.col("rows") - F.col("n")).alias("missing"), "mean", "median", "std", "variance", F.try_divide("std", F.abs("mean")).alias("cv"),
        "min", "q1", "q3", "max", (F.col("q3") - F.col("q1")).alias("iqr"), (F.col("max") - F.col("min")).alias("range"),
        sample_skew(n, F.col("g1")).alias("skewness"), sample_kurtosis(n, F.col("g2")).alias("kurtosis"), (F.col("std") / F.sqrt(n)).alias("sem"),
    )


def percentiles(df: DataFrame, cols: list[str], probs=(0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    q = quantiles(df, cols, list(probs))
    rows = [(c, *(q[c] or [None] * len(probs))) for c in cols if q[c] or not df.isEmpty()]
    return df.sparkSession.createDataFrame(rows, "variable string, " + ", ".join(f"p{round(100 * p)} double" for p in probs))


def describe_categorical(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct values, mode (the least on ties), its share, entropy in nats and relative to its greatest: sums over value counts."""
    vc = value_counts(df, cols).where("value is not null")
    n = F.col("n")
    got = vc.groupBy("variable").agg(F.count(F.lit(1)).alias("distinct"), F.min_by("value", F.struct(-n, "value")).alias("mode"), F.max(n).alias("most"), F.sum(n).alias("all"), F.sum(n * F.log(n)).alias("h"))
    entropy = F.greatest(F.log("all") - F.col("h") / F.col("all"), F.lit(0.0))
    got = got.select("variable", "distinct", "mode", (F.col("most") / F.col("all")).alias("mode_share"), entropy.alias("entropy"))
    return got.withColumn("relative_entropy", F.when(F.col("distinct") > 1, F.col("entropy") / F.log("distinct")).otherwise(0.0))


def top_values(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    vc = value_counts(df, cols).where("value is not null")
    w = Window.partitionBy("variable").orderBy(F.desc("n"), "value")
    return vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    got = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    share = F.col("n") / F.sum("n").over(w)  # over one row a class
    low = F.min("n").over(w) / F.sum("n").over(w)
    return got.select("level", "n", share.alias("share"), low.alias("minority_share"), (F.max("n").over(w) / F.min("n").over(w)).alias("ratio"), (low < 0.2).alias("imbalanced"), (low < 0.05).alias("severe"))


def count_duplicates(df: DataFrame) -> DataFrame:
    """Rows, repeated rows and their share, by grouping on two hashes of the row."""
    h = df.select(F.xxhash64(*df.columns).alias("a"), F.hash(*df.columns).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return h.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates")).withColumn("share", F.col("duplicates") / F.col("rows"))


def group_summary(df: DataFrame, group: str, measure: str, top: int = 30) -> DataFrame:
    x = df.select(F.col(group).cast("string").alias("level"), clean(measure).alias("v"))
    got = x.groupBy("level").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")).orderBy(F.desc("n"), "level").limit(top)
    mid = group_quantiles(x.join(got.select(F.col("level").alias("_l")), F.col("level").eqNullSafe(F.col("_l")), "left_semi"), ["level"], "v", [0.5])
    mid = mid.select(F.col("level").alias("_l"), F.col("q")[0].alias("median"))
    return got.join(mid, F.col("level").eqNullSafe(F.col("_l")), "left").select("level", "n", "mean", "median", "std")


def outlier_table(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """Bounds by the quartiles, and what lies beyond: a pass for quartiles, a pass for counts."""
    q = quantiles(df, cols, [0.25, 0.75])
    x = long_form(df.select(*[clean(c).alias(c) for c in cols]), cols, cast="double").where("value is not null")
    low = {c: q[c][0] - k * (q[c][1] - q[c][0]) for c in cols if q[c]}
    high = {c: q[c][1] + k * (q[c][1] - q[c][0]) for c in cols if q[c]}
    lo, hi = (F.create_map(*[x for c in d for x in (F.lit(c), F.lit(d[c]))])[F.col("variable")] for d in (low, high))
    x = x.withColumn("lower", lo).withColumn("upper", hi)
    out = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return x.groupBy("variable", "lower", "upper").agg(F.count_if(out).alias("outliers"), (F.count_if(out) / F.count(F.lit(1))).alias("share"), F.min(F.when(out, F.col("value"))).alias("least"), F.max(F.when(out, F.col("value"))).alias("greatest"))


def covariance_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    n, _, s = gram(df, cols)
    rows = [(a, b, float(s[i, j] / (n - 1))) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, covariance double")


def with_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each column with its average ranks instead (null stays null)."""
    for c in cols:
        r = global_ranks(df.select(c), c).select(F.col(c).alias("_v"), F.col("rank").alias("_r"))
        df = df.join(r, F.col(c) == F.col("_v"), "left").drop("_v", c).withColumnRenamed("_r", c)
    return df


def correlation_matrix(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    x = df.select(*[clean(c).alias(c) for c in cols])
    if method == "spearman":
        x = with_ranks(x.dropna(), cols)
    _, _, s = gram(x, cols)
    d = np.sqrt(np.diag(s))
    rows = [(a, b, float(s[i, j] / (d[i] * d[j])) if d[i] * d[j] else None) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Every pair over the rows complete in it: n, r, p and a reading, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    both = lambda a, b: clean(a).isNotNull() & clean(b).isNotNull()
    row = df.agg(*[F.struct(F.count_if(both(a, b)), safe_corr(clean(a), clean(b))) for a, b in pairs]).first()
    rows = []
    for (a, b), (n, r) in zip(pairs, row, strict=True):
        p = t_two_sided(r * np.sqrt((n - 2) / max(1e-300, 1 - r * r)), n - 2) if r is not None and n > 2 else None
        rows.append((a, b, n, r, None if p is None else float(p)))
    got = df.sparkSession.createDataFrame(rows, "a string, b string, n long, r double, p double")
    return got.withColumn("strength", strength("r")).orderBy(F.desc(F.abs("r")), "a", "b")


def nonlinearity_signal(df: DataFrame, cols: list[str], gap: float = 0.15, least: float = 0.4) -> DataFrame:
    p = correlation_matrix(df, cols).withColumnRenamed("r", "pearson")
    s = correlation_matrix(df, cols, "spearman").withColumnRenamed("r", "spearman")
    got = p.join(s, ["a", "b"]).where("a < b")
    return got.withColumn("nonlinear", (F.abs("spearman") - F.abs("pearson") > gap) & (F.abs("spearman") > least))


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation: the diagonal of the inverse correlation matrix."""
    _, _, s = gram(df, cols)
    d = np.sqrt(np.diag(s))
    v = np.diag(np.linalg.pinv(s / np.outer(d, d)))
    return df.sparkSession.createDataFrame([(c, float(x)) for c, x in zip(cols, v, strict=True)], "variable string, vif double")


def histogram_bins(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("left", lo + F.col("bin") * width)


def box_stats(df: DataFrame, group: str, col: str, top: int = 10) -> DataFrame:
    most = df.groupBy(F.col(group).alias("level")).agg(F.count(col).alias("n")).orderBy(F.desc("n"), "level").limit(top)
    q = most.join(group_quantiles(df.select(F.col(group).alias("level"), col), ["level"], col, [0.25, 0.5, 0.75]), "level")
    q = q.select("level", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    got = df.select(F.col(group).alias("level"), F.col(col).alias("v")).join(q, "level")
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    return got.groupBy("level", "n", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"))


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"))
