"""Checks of new data against old: schema, drift, versions, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.scalar import chain, clean
from tesserae.operators.describe import count_duplicates
from tesserae.operators.kernels import column_counts, value_counts
from tesserae.operators.profile import leakage_suspects
from tesserae.operators.rows import join_share_diff


def column_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, status): kept, added or removed."""
    spark = old.sparkSession
    a = spark.createDataFrame([(c, 1) for c in old.columns], "name string, _a int")
    b = spark.createDataFrame([(c, 1) for c in new.columns], "name string, _b int")
    status = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").otherwise("kept")
    return a.join(b, "name", "full_outer").select("name", status.alias("status"))


def kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "numeric"
    return "datetime" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"


def schema_check(old: DataFrame, new: DataFrame, categories: list[str] = ()) -> DataFrame:
    """(code, column, severity, detail): columns missing (fatal), extra or of another kind, levels never seen (the first ten as detail), more gaps than before."""
    a, b = ({f.name: kind(f.dataType) for f in df.schema.fields} for df in (old, new))
    rows = [("missing_column", c, "fatal", None) for c in a if c not in b]
    rows += [("extra_column", c, "info", None) for c in b if c not in a]
    rows += [("kind_changed", c, "warning", f"{a[c]} to {b[c]}") for c in a if c in b and a[c] != b[c]]
    both = [c for c in a if c in b]
    gaps = []
    for df in (old, new):
        gaps.append(df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in both]).first())
    rows += [("more_missing", c, "warning", None) for c in both if (gaps[1][c] or 0) > max(0.05, 2 * (gaps[0][c] or 0))]
    for c in categories:
        unseen = new.where(F.col(c).isNotNull()).select(c).distinct().join(old.select(c).distinct(), c, "left_anti")
        if found := [str(r[0]) for r in unseen.orderBy(c).limit(10).collect()]:
            rows.append(("unseen_category", c, "warning", ", ".join(found)))
    return old.sparkSession.createDataFrame(rows, "code string, column string, severity string, detail string")


def drift_report(old: DataFrame, new: DataFrame, numeric: list[str], categorical: list[str], least: int = 30) -> DataFrame:
    """(variable, kind, drift, reading): standardised shifts of means; total variation of shares."""
    agg = [F.count(F.lit(1)).alias("_n")] + [f(clean(c)).alias(f"{c}_{n}") for c in numeric for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))]
    a, b = (df.agg(*agg).first() for df in (old, new))
    few = min(a["_n"], b["_n"]) < least
    rows = []
    for c in numeric:
        shift = None if not a[f"{c}_s"] or b[f"{c}_m"] is None else (b[f"{c}_m"] - a[f"{c}_m"]) / a[f"{c}_s"]
        rows.append((c, "numeric", shift))
    for c in categorical:
        rows.append((c, "categorical", join_share_diff(old, new, c).agg(F.sum(F.abs("difference")) / 2).first()[0]))
    got = old.sparkSession.createDataFrame(rows, "variable string, kind string, drift double")
    d = F.abs("drift")
    num = chain([(d < 0.1, "none"), (d < 0.3, "slight"), (d < 0.8, "moderate")], "large")
    cat = chain([(d < 0.05, "none"), (d < 0.15, "slight"), (d < 0.35, "moderate")], "large")
    reading = F.when(F.lit(few) | F.col("drift").isNull(), "undecidable").when(F.col("kind") == "numeric", num).otherwise(cat)
    return got.withColumn("reading", reading)


def version_snapshot(df: DataFrame, most_levels: int = 200) -> DataFrame:
    """(variable, kind, rows, missing, distinct, mean, std, levels): one row a column. levels: those of text with few of them."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    counts = column_counts(df, df.columns, mode=False)
    few = [r.variable for r in counts.where(F.col("distinct") <= most_levels).collect() if r.variable not in numeric]
    if few:
        levels = value_counts(df, few).where("value is not null").groupBy("variable").agg(F.array_sort(F.collect_list("value")).alias("levels"))  # most_levels at most
        counts = counts.join(levels, "variable", "left")
    else:
        counts = counts.withColumn("levels", F.lit(None).cast("array<string>"))
    kinds = df.sparkSession.createDataFrame([(f.name, kind(f.dataType)) for f in df.schema.fields], "variable string, kind string")
    got = counts.join(kinds, "variable")
    if not numeric:
        return got.withColumns({"mean": F.lit(None).cast("double"), "std": F.lit(None).cast("double")})
    stats = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), clean(c).alias("v")) for c in numeric]))).groupBy("variable").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    return got.join(stats, "variable", "left")


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(variable, change): columns added or removed, kind, missing share by 2 points, mean by 0.2 deviations, levels; a row without variable if the number of rows differs."""
    a, b = (s.toDF(*[x if x == "variable" else f"{p}_{x}" for x in s.columns]) for p, s in (("a", version_snapshot(old)), ("b", version_snapshot(new))))
    gap = F.abs(F.col("a_missing") / F.col("a_rows") - F.col("b_missing") / F.col("b_rows")) >= 0.02
    shift = F.coalesce(F.abs(F.col("b_mean") - F.col("a_mean")) >= 0.2 * F.col("a_std"), F.lit(False))
    change = chain([(F.col("b_kind").isNull(), "removed"), (F.col("a_kind").isNull(), "added"), (F.col("a_kind") != F.col("b_kind"), "kind"), (gap, "missing"), (shift, "mean"), (~F.col("a_levels").eqNullSafe(F.col("b_levels")), "levels")], "same")
    rows = a.agg(F.max("a_rows").alias("a")).crossJoin(b.agg(F.max("b_rows").alias("b"))).where(~F.col("a").eqNullSafe(F.col("b")))  # one row each
    return a.join(b, "variable", "full_outer").select("variable", change.alias("change")).unionAll(rows.select(F.lit(None).cast("string"), F.lit("rows")))


def build_contract(df: DataFrame, most_levels: int = 200) -> dict:
    """Required columns, kinds, level sets, gap limits and least rows, from aggregates."""
    snap = version_snapshot(df).collect()
    rows = max((r["rows"] for r in snap), default=0)
    text = [r["variable"] for r in snap if r["kind"] == "text" and r["distinct"] <= most_levels]
    levels = {r["variable"]: list(r["levels"] or []) for r in snap if r["variable"] in text}
    return {"kinds": {r["variable"]: r["kind"] for r in snap}, "levels": {c: sorted(v) for c, v in levels.items()}, "missing": {r["variable"]: max(0.05, 2 * r["missing"] / max(1, r["rows"])) for r in snap}, "least_rows": max(30, rows // 100)}


def contract_rows(contract: dict, spark) -> DataFrame:
    rows = [(c, k, len(contract["levels"].get(c, [])) or None, float(contract["missing"][c])) for c, k in contract["kinds"].items()]
    return spark.createDataFrame(rows, "variable string, kind string, levels long, missing_limit double")


def check_contract(df: DataFrame, contract: dict, target: str | None = None, task: str | None = None, time_column: str | None = None) -> DataFrame:
    """(rule, variable, passed, severity) from one aggregate over the table and a count of repeated rows.

    task: classification asks for two classes, forecast for the time column. Rules are blocking or warnings;
    a target missing in over 60 % of the rows blocks.
    """
    have = [c for c in contract["kinds"] if c in df.columns]
    agg = [F.count(F.lit(1)).alias("_rows")] + [F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}") for c in have]
    agg += [F.count_if(F.col(c).isNotNull() & ~F.col(c).cast("string").isin(contract["levels"][c])).alias(f"u_{c}") for c in have if contract["levels"].get(c)]
    aimed = target in df.columns
    if aimed:
        agg.append(F.avg(F.col(target).isNull().cast("double")).alias("_gaps"))
    row = df.agg(*agg).first()
    out = [("column_present", c, c in df.columns, "blocking") for c in contract["kinds"]]
    out += [("missing_share", c, (row[f"m_{c}"] or 0.0) <= contract["missing"][c], "warning") for c in have]
    out += [("known_levels", c, row[f"u_{c}"] == 0, "warning") for c in have if contract["levels"].get(c)]
    out += [("few_levels", c, len(v) <= 50, "warning") for c, v in contract["levels"].items()]
    out.append(("least_rows", None, row["_rows"] >= contract["least_rows"], "blocking"))
    repeated = count_duplicates(df).first()["duplicates"] or 0
    out.append(("duplicates", None, repeated <= 0.05 * row["_rows"], "warning"))
    suspects = leakage_suspects(df, target if aimed and isinstance(df.schema[target].dataType, T.NumericType) else None)
    out.append(("leakage", None, suspects.isEmpty(), "warning"))
    if target:
        out.append(("target_present", target, aimed, "blocking"))
    if aimed:
        gaps = row["_gaps"] or 0.0
        out.append(("target_missing", target, gaps <= 0.3, "blocking" if gaps > 0.6 else "warning"))
        if task == "classification":
            out.append(("classes", target, df.where(F.col(target).isNotNull()).select(target).distinct().limit(2).count() == 2, "blocking"))
    if task == "forecast":
        out.append(("time_column", time_column, time_column in df.columns, "blocking"))
    return df.sparkSession.createDataFrame(out, "rule string, variable string, passed boolean, severity string")


def row_rules(contract: dict, columns: list[str]):
    """Whether a row keeps the contract: known levels and no gap where none was seen."""
    ok = F.lit(True)
    for c in columns:
        if contract["levels"].get(c):
            ok = ok & F.coalesce(F.col(c).cast("string").isin(contract["levels"][c]), F.lit(True))
        if contract["missing"].get(c, 1) <= 0.05:
            ok = ok & F.col(c).isNotNull()
    return ok
