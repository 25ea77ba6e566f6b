"""What clusters look like: profiles, defining and separating features, representative rows, indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalar import clean
from tesserae.operators.kernels import long_form
from tesserae.sources.written import written


def _whole(df: DataFrame, cols: list[str]) -> dict:
    row = df.agg(*[f(clean(c)).alias(f"{c}|{n}") for c in cols for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    return {c: (row[f"{c}|m"], row[f"{c}|s"] or 1.0) for c in cols}


def cluster_profile(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """(cluster, variable, n, share, mean, deviation): deviations in population standard deviations of the whole."""
    whole = _whole(df, cols)
    x = long_form(df.select(F.col(cluster).alias("cluster"), *[clean(c).alias(c) for c in cols]), cols, "cluster", cast="double")
    g = x.groupBy("cluster", "variable").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    m, s = (F.create_map(*[v for c in cols for v in (F.lit(c), F.lit(whole[c][i]))])[F.col("variable")] for i in (0, 1))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("variable"))  # over one row a cluster
    return g.select("cluster", "variable", "n", share.alias("share"), "mean", ((F.col("mean") - m) / s).alias("deviation"))


def defining_features(df: DataFrame, cluster: str, cols: list[str], k: int = 3, least: float = 0.25) -> DataFrame:
    w = Window.partitionBy("cluster").orderBy(F.desc(F.abs("deviation")), "variable")
    p = cluster_profile(df, cluster, cols).where(F.abs("deviation") >= least)
    return p.select("cluster", "variable", "deviation", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


#: Parts of a cluster whose least distances bound the k-th of the whole.
PARTS = 1024


def _within_bound(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """rows (cluster, distance and key) less those that cannot be among their cluster's k nearest: the k-th of the
    least distances of its parts is no less than the k-th of all. Only sums of a part are held, no rows are sorted."""
    part = F.pmod(F.xxhash64(*key), F.lit(max(PARTS, 4 * k)))
    least = rows.groupBy("cluster", part.alias("_p")).agg(F.min("distance").alias("_d"))
    bound = least.groupBy(F.col("cluster").alias("_b")).agg(F.sort_array(F.collect_list("_d")).alias("_d"))
    bound = bound.select("_b", F.get("_d", F.lit(k - 1)).alias("_d"))
    near = F.col("distance").isNull() | F.col("_d").isNull() | (F.col("distance") <= F.col("_d"))
    return rows.join(bound, F.col("cluster") == F.col("_b")).where(near).drop("_b", "_d")


def representative_rows(df: DataFrame, cluster: str, cols: list[str], key: list[str], k: int = 3) -> DataFrame:
    """The rows nearest each cluster's centre, in standardised distance; only rows within a bound of the k-th distance are ranked."""
    whole = _whole(df, cols)
    centre = written(df.groupBy(F.col(cluster).alias("_c")).agg(*[F.avg(clean(c)).alias(f"_m_{c}") for c in cols]))
    x = df.join(centre, F.col(cluster) == F.col("_c"))
    dist = sum((((clean(c) - F.col(f"_m_{c}")) / whole[c][1]) ** 2 for c in cols), F.lit(0.0))
    rows = x.select(F.col(cluster).alias("cluster"), *key, dist.alias("distance"))
    w = Window.partitionBy("cluster").orderBy("distance", *key)
    return _within_bound(rows, key, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def separating_features(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """F and eta squared of every column by cluster, from one aggregate."""
    x = long_form(df.select(F.col(cluster).alias("_c"), *[clean(c).alias(c) for c in cols]), cols, "_c", cast="double").where("value is not null")
    g = x.groupBy("variable", "_c").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    w = Window.partitionBy("variable")
    g = g.withColumn("gm", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    a = g.groupBy("variable").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * (F.col("m") - F.col("gm")) ** 2).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"))
    return a.select("variable", ((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("f"), (F.col("b") / (F.col("b") + F.col("w"))).alias("eta_squared"))


def separating_categories(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """Chi-square, its degrees of freedom and Cramer's V of categorical columns by cluster, from one count of cells."""
    x = long_form(df.select(F.col(cluster).cast("string").alias("_c"), *cols), cols, "_c").where("value is not null and _c is not null")
    cells = x.groupBy("variable", "_c", "value").agg(F.count(F.lit(1)).alias("k"))
    row, col = (cells.groupBy("variable", c).agg(F.sum("k").alias(n)) for c, n in (("_c", "r"), ("value", "l")))
    whole = row.groupBy("variable").agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("rows")).join(col.groupBy("variable").agg(F.count(F.lit(1)).alias("levels")), "variable")
    # chi2 = n (sum k^2 / (row total * level total) - 1), so empty cells need no rows
    g = cells.join(row, ["variable", "_c"]).join(col, ["variable", "value"]).groupBy("variable").agg(F.sum(F.col("k") * F.col("k") / (F.col("r") * F.col("l"))).alias("q"))
    chi = F.col("n") * (F.col("q") - 1)
    few = F.least("rows", "levels") - 1
    return g.join(whole, "variable").select("variable", chi.alias("chi_square"), ((F.col("rows") - 1) * (F.col("levels") - 1)).alias("df"), F.sqrt(F.try_divide(chi, F.col("n") * few)).alias("cramers_v"))


def cluster_modes(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """(cluster, variable, mode, share) of categorical columns; the least value on ties."""
    x = long_form(df.select(F.col(cluster).alias("cluster"), *cols), cols, "cluster").where("value is not null")
    vc = x.groupBy("cluster", "variable", "value").agg(F.count(F.lit(1)).alias("n"))
    return vc.groupBy("cluster", "variable").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"), (F.max("n") / F.sum("n")).alias("share"))


def davies_bouldin(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """Mean over clusters of the worst ratio of spreads to the distance of centres; a pass for centres, a pass for spreads."""
    x = df.select(F.col(cluster).alias("_c"), *[clean(c).alias(c) for c in cols]).dropna()
    centre = x.groupBy("_c").agg(*[F.avg(c).alias(f"m_{c}") for c in cols])
    away = F.sqrt(sum(((F.col(c) - F.col(f"m_{c}")) ** 2 for c in cols), F.lit(0.0)))
    g = x.join(centre, "_c").groupBy("_c", *[f"m_{c}" for c in cols]).agg(F.avg(away).alias("s"))
    a, b = (g.toDF(*[f"{p}{c}" for c in g.columns]) for p in ("a", "b"))
    apart = F.sqrt(sum(((F.col(f"am_{c}") - F.col(f"bm_{c}")) ** 2 for c in cols), F.lit(0.0)))
    pairs = a.join(b, F.col("a_c") != F.col("b_c"))  # one row a pair of clusters
    return pairs.groupBy("a_c").agg(F.max(F.try_divide(F.col("as") + F.col("bs"), apart)).alias("worst")).agg(F.avg("worst").alias("davies_bouldin"))


def clustering_metrics(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """Clusters, rows, Calinski-Harabasz and size imbalance, from centroid aggregates."""
    x = df.select(F.col(cluster).alias("_c"), *[clean(c).alias(c) for c in cols]).dropna()
    g = x.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols], sum((F.var_pop(c) for c in cols), F.lit(0.0)).alias("v"))
    every = Window.partitionBy()  # over one row a cluster
    far = sum(((F.col(f"m_{c}") - F.sum(F.col("n") * F.col(f"m_{c}")).over(every) / F.sum("n").over(every)) ** 2 for c in cols), F.lit(0.0))
    a = g.withColumn("far", far).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("far")).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), (F.max("n") / F.min("n")).alias("imbalance"))
    return a.select("k", "n", ((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"), "imbalance")
