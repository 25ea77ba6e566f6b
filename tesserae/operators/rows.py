"""Filters, selections, duplicates, the joins that other operators use, windows and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.scalar import clean
from tesserae.operators.kernels import quantiles
from tesserae.sources.written import written


def select_columns(df: DataFrame, keep=None, drop=None) -> DataFrame:
    names = [c for c in df.columns if (keep is None or c in keep) and c not in (drop or ())]
    return df.select(*names)


def select_by_kind(df: DataFrame, kind: str) -> list[str]:
    """Column names for __all__, __numeric__, __non_numeric__ or __datetime__."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    return {"__all__": df.columns, "__numeric__": numeric, "__non_numeric__": [c for c in df.columns if c not in numeric], "__datetime__": dates}[kind]


def drop_constant_columns(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    cols = select_by_kind(df, "__numeric__")
    var = df.agg(*[F.var_pop(clean(c)).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if (var[c] or 0.0) <= threshold])


def comparison(col: str, op: str, value):
    """==, != compare text without case; the others compare numbers; a null is never matched."""
    c = F.col(col)
    if op in ("==", "!="):
        same = F.lower(c.cast("string")) == str(value).lower()
        return F.coalesce(same if op == "==" else ~same, F.lit(False))
    n = c.try_cast("double")
    return F.coalesce({">": n > value, ">=": n >= value, "<": n < value, "<=": n <= value}[op], F.lit(False))


def filter_comparison(df: DataFrame, conditions: dict[str, dict]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [comparison(c, x["op"], x["value"]) for c, x in conditions.items()]))


def filter_counts(df: DataFrame, conditions: dict[str, dict]) -> DataFrame:
    """Rows before and after, in one pass."""
    keep = reduce(lambda a, b: a & b, [comparison(c, x["op"], x["value"]) for c, x in conditions.items()])
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(keep).alias("rows_after"))


def drop_duplicates(df: DataFrame, subset: list[str], order_by: list[str]) -> DataFrame:
    """The first row of each, in the given order."""
    w = Window.partitionBy(*subset).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def drop_rows_missing(df: DataFrame, cols: list[str], share: float | None = None) -> DataFrame:
    missing = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.where(missing == 0 if share is None else missing / len(cols) < share)


def remove_outlier_rows(df: DataFrame, cols: list[str], k: float = 3.0) -> DataFrame:
    q = quantiles(df, cols, [0.25, 0.75])
    keep = F.lit(True)
    for c in cols:
        lo, hi = q[c]
        if hi > lo:
            v = clean(c)
            keep = keep & F.coalesce((v >= lo - k * (hi - lo)) & (v <= hi + k * (hi - lo)), F.lit(True))
    return df.where(keep)


def drop_empty_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull())


def join_category_map(df: DataFrame, col: str, learned: DataFrame, default) -> DataFrame:
    """learned: (level, code). Spark chooses to broadcast it by its size."""
    m = learned.select(F.col("level").alias("_l"), "code")
    return df.join(m, F.col(col) == F.col("_l"), "left").drop("_l").withColumn("code", F.coalesce("code", F.lit(default)))


def join_group_statistic(df: DataFrame, group: str, measure: str) -> DataFrame:
    """measure with gaps filled by its group's mean, else by the whole mean."""
    # written, so that its size is known before the join: few groups are broadcast, and no task gets all rows of a group
    g = written(df.groupBy(F.col(group).alias("_g")).agg(F.avg(measure).alias("_m")))
    whole = df.agg(F.avg(measure)).first()[0]
    return df.join(g, F.col(group) == F.col("_g"), "left").withColumn(measure, F.coalesce(measure, "_m", F.lit(whole))).drop("_g", "_m")


def join_unseen_categories(old: DataFrame, new: DataFrame, col: str) -> DataFrame:
    return new.where(F.col(col).isNotNull()).select(col).distinct().join(old.select(col).distinct(), col, "left_anti")


def join_share_diff(old: DataFrame, new: DataFrame, col: str) -> DataFrame:
    def share(df, name):
        n = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
        return n.select(col, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))  # over one row a level

    both = share(old, "share_old").join(share(new, "share_new"), col, "full_outer").na.fill(0.0, ["share_old", "share_new"])
    return both.withColumn("difference", F.col("share_new") - F.col("share_old"))


def join_pairs_complete(a: DataFrame, b: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return a.select(key, x).join(b.select(key, y), key).dropna(subset=[x, y])


def union_tables(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def rank_top_n(df: DataFrame, by: str, n: int, key: str) -> DataFrame:
    """The n rows greatest in a measure, each one's share of the total, and the running share."""
    total = df.agg(F.sum(by).alias("total"))
    top = df.orderBy(F.desc(by), key).limit(n)
    w = Window.orderBy(F.desc(by), key)  # over n rows
    top = top.withColumn("rank", F.row_number().over(w)).withColumn("running", F.sum(by).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = top.crossJoin(total)  # one row
    return got.select("rank", key, by, (F.col(by) / F.col("total")).alias("share"), (F.col("running") / F.col("total")).alias("running_share"))


def moving_average(df: DataFrame, key: str, t: str, y: str, width: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(t).rowsBetween(1 - width, 0)
    return df.withColumn("moving_average", F.avg(y).over(w))


def lag_features(df: DataFrame, key: str, t: str, y: str, lags: list[int], season: int | None = None) -> DataFrame:
    w = Window.partitionBy(key).orderBy(t)
    out = df.withColumns({f"lag_{k}": F.lag(y, k).over(w) for k in lags}).withColumn("time_index", F.row_number().over(w) - 1)
    if season:
        angle = F.col("time_index") * (2 * 3.141592653589793 / season)
        out = out.withColumn("season_sin", F.sin(angle)).withColumn("season_cos", F.cos(angle))
    return out


def forward_fill(df: DataFrame, key: str, t: str, col: str, back: bool = False) -> DataFrame:
    w = Window.partitionBy(key).orderBy(t)
    value = F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if back:
        value = F.coalesce(value, F.first(col, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return df.withColumn(col, value)


def difference_series(df: DataFrame, key: str, t: str, y: str, order: int = 1) -> DataFrame:
    w = Window.partitionBy(key).orderBy(t)
    for _ in range(order):
        df = df.withColumn(y, F.col(y) - F.lag(y).over(w))
    return df


def largest_errors(df: DataFrame, actual: str, predicted: str, key: list[str], n: int = 10) -> DataFrame:
    r = df.withColumn("residual", F.col(actual) - F.col(predicted))
    return r.orderBy(F.desc(F.abs("residual")), *key).limit(n)
