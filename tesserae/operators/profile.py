"""The profile of a table: semantic types, measures of each column, suspects, issues and scores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.scalar import chain, clean, numeric_text
from tesserae.operators.describe import correlation_pairs, count_duplicates, sample_kurtosis, sample_skew, vif
from tesserae.operators.kernels import COUNTED, column_counts, group_quantiles, quantiles, safe_corr, value_counts

# Name patterns and ordered vocabularies of the type rules, thresholds and penalties of the issues.
ID_NAME = r"(?i)^(id|uuid|guid|key|code|ref|reference|number|no|nr|index|idx)$|(_id|_uuid|_guid|_key|_code|_ref|_no|_nr|_number)$|^(id_|uuid_|key_)"
DATE_NAME = r"(?i)(date|time|timestamp|datetime|day|month|year|quarter|week|period|dt)$|^(date|time|timestamp|datetime|dt)"
DATE_SHAPE = r"^\s*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd-MM-yyyy"]
TARGET_NAME = (
    r"(?i)(target|label|outcome|response|churn|converted|conversion|purchase|purchased|buy|bought|revenue|sales|spend|spending|price|amount|value|score|rating|"
    r"default|fraud|risk|success|survived|status|class|result|profit|margin|quantity|demand|yield|attrition|renewal|subscribe|click|approved)"
)
LEAK_NAME = r"(?i)(predicted|prediction|forecast|score_|_score$|probability|propensity|post_|after_|final_|actual_|_flag_computed|model_)"
GRADED = r"^(grade|level|tier|band|stage)\s*[a-z0-9]"
ORDINAL = [
    ["low", "medium", "high"],
    ["low", "med", "high"],
    ["small", "medium", "large"],
    ["poor", "fair", "good", "excellent"],
    ["bronze", "silver", "gold", "platinum"],
    ["never", "rarely", "sometimes", "often", "always"],
    ["strongly disagree", "disagree", "neutral", "agree", "strongly agree"],
    ["very low", "low", "medium", "high", "very high"],
    ["beginner", "intermediate", "advanced"],
]
THRESHOLDS = {
    "identifier_ratio": 0.95, "high_cardinality": 50, "high_cardinality_ratio": 0.5, "near_constant": 0.99, "discrete": 20, "text_tokens": 3.0, "text_chars": 25.0,
    "missing_warning": 0.05, "missing_critical": 0.40, "outlier_share": 0.05, "skew": 1.0, "correlation": 0.85, "leakage": 0.98, "vif_warning": 5.0, "vif_critical": 10.0, "small_sample": 100, "wide_data": 0.5,
}
PENALTY = {"critical": 12, "warning": 5, "info": 1}
DIMENSION_PENALTY = {"critical": 45, "warning": 18, "info": 5}
DIMENSIONS = {
    "Completeness": ["severe_missingness", "missing_values"],
    "Uniqueness": ["duplicate_rows", "identifier_columns"],
    "Consistency": ["constant_columns", "near_constant_columns", "high_cardinality"],
    "Distribution": ["outliers", "skewed_distributions"],
    "Independence": ["high_correlation", "multicollinearity", "possible_leakage"],
    "Sufficiency": ["small_sample", "wide_data"],
}

#: Distinct values up to which an approximate count is made exact by listing them.
FEW = 200


def to_timestamp(c):
    """A tolerant parse: the first of the known formats that fits."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS], c.try_cast("timestamp"))


def _is_numeric(f) -> bool:
    return isinstance(f.dataType, T.NumericType)


def _distinct_counts(df: DataFrame, near: dict[str, tuple[int, int]]) -> dict[str, int]:
    """Distinct values of each column: near (approximate count, values) is made exact where a rule could turn on it."""
    few = [c for c, (a, _) in near.items() if a <= FEW]
    out = {c: a for c, (a, _) in near.items()}
    if few:
        row = df.agg(*[F.size(F.collect_set(F.col(f"`{c}`"))).alias(c) for c in few]).first()
        out |= {c: row[c] for c in few}
    edge = [c for c, (a, n) in near.items() if a > FEW and (a > 0.85 * n or 0.4 * n < a < 0.6 * n)]  # an identifier or a high share of levels hangs on it
    if edge:
        out |= {r.variable: r.distinct for r in column_counts(df, edge, mode=False).collect()}
    return out


def _close_sequence(df: DataFrame, c: str) -> bool:
    """Whether values, all different, mostly follow the next lower one by two at most."""
    x = df.select(F.col(f"`{c}`").cast("double").alias("v")).where("v is not null")
    after = x.select((F.col("v") + 1).alias("v")).unionAll(x.select((F.col("v") + 2).alias("v"))).distinct()
    return x.join(after, "v", "left_semi").count() >= x.count() / 2


#: Aggregates of one pass: more make one piece of generated code that the JVM leaves uncompiled; passes read only their columns.
PIECE = 12


def _in_pieces(df: DataFrame, agg: list) -> dict:
    """What many aggregates give by name, some at a time."""
    out: dict = {}
    for a in range(0, len(agg), PIECE):
        out |= df.agg(*agg[a : a + PIECE]).first().asDict()
    return out


def _text_measures() -> list:
    """What the rules ask of a text column, from its values _s and the rows _n of each."""
    s, n = F.col("_s"), F.col("_n")
    mean = lambda v: F.try_divide(F.sum(v.cast("double") * n), F.sum(F.when(v.isNotNull(), n)))
    low, number = F.lower(F.trim(s)), numeric_text(s)
    ordered = F.greatest(*[mean(low.isin(v)) for v in ORDINAL], mean(low.rlike(GRADED)))
    parts = {"l": mean(F.length(s)), "w": mean(F.size(F.split(F.trim(s), r"\s+"))), "m": F.try_divide(F.sum(F.when(number.isNotNull(), n).otherwise(0)), F.sum(n)), "x": F.coalesce(F.sum(F.when(number != F.floor(number), n)), F.lit(0))}
    parts |= {"s": mean(s.rlike(DATE_SHAPE)), "t": F.try_divide(F.sum(F.when(to_timestamp(s).isNotNull(), n).otherwise(0)), F.sum(n)), "o": ordered}
    return [v.alias(k) for k, v in parts.items()]


def infer_semantic_types(df: DataFrame) -> DataFrame:
    """(column, semantic_type) by rules over a few aggregates; exact distinct counts only where a rule is near its edge."""
    named = [(i, f, F.col(f"`{f.name}`")) for i, f in enumerate(df.schema.fields)]
    r = df.agg(F.count(F.lit(1)).alias("rows"), *[a for i, _, c in named for a in (F.count(c).alias(f"n{i}"), F.approx_count_distinct(c, 0.02).alias(f"d{i}"))]).first().asDict()
    r |= {f"x{i}": 0 for i, f, _ in named if _is_numeric(f)}  # whole types have no fractions
    fractions = [F.count_if(clean(c) != F.floor(clean(c))).alias(f"x{i}") for i, f, c in named if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType))]
    r |= _in_pieces(df, fractions)
    for i, f, c in named:
        if isinstance(f.dataType, T.StringType):
            # few different texts are judged once each and weighed by their rows
            few = r[f"d{i}"] <= COUNTED
            cells = df.groupBy(c.alias("_s")).agg(F.count(F.lit(1)).alias("_n")) if few else df.select(c.alias("_s"), F.lit(1).alias("_n"))
            r |= {f"{k}{i}": v for k, v in cells.agg(*_text_measures()).first().asDict().items()}
    fields = df.schema.fields
    distinct = _distinct_counts(df, {f.name: (r[f"d{i}"], r[f"n{i}"]) for i, f in enumerate(fields)})
    out = [(f.name, _type(df, f, i, r, distinct[f.name])) for i, f in enumerate(fields)]
    return df.sparkSession.createDataFrame(out, "column string, semantic_type string")


def _number_type(df, name: str, whole: bool, d: int, n: int, rows: int, values: DataFrame) -> str:
    if d == 2:
        return "binary"
    if whole and d / n >= THRESHOLDS["identifier_ratio"] and rows > 20 and (re.search(ID_NAME, name) or d == n and _close_sequence(values, name)):
        return "identifier"
    return "numeric_discrete" if whole and d <= THRESHOLDS["discrete"] else "numeric_continuous"


def _type(df, f, i, r, d) -> str:
    t, n, rows = THRESHOLDS, r[f"n{i}"], r["rows"]
    if d <= 1:
        return "constant"
    if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(f.dataType, T.BooleanType):
        return "binary"
    if _is_numeric(f):
        return _number_type(df, f.name, r[f"x{i}"] == 0, d, n, rows, df)
    if not isinstance(f.dataType, T.StringType):
        return "unknown"
    if (re.search(DATE_NAME, f.name) or r[f"s{i}"] > 0.8) and r[f"t{i}"] >= 0.9:
        return "datetime"
    if r[f"m{i}"] > 0.95:
        return _number_type(df, f.name, r[f"x{i}"] == 0, d, n, rows, df.select(numeric_text(F.col(f"`{f.name}`")).alias(f.name)))
    if d == 2:
        return "binary"
    if d / n >= t["identifier_ratio"] and rows > 20 and r[f"w{i}"] < t["text_tokens"]:
        return "identifier"
    if r[f"w{i}"] >= t["text_tokens"] and r[f"l{i}"] >= t["text_chars"]:
        return "text"
    if d <= 15 and r[f"o{i}"] == 1.0:
        return "categorical_ordinal"
    return "high_cardinality_categorical" if d > t["high_cardinality"] or d / n > t["high_cardinality_ratio"] else "categorical_nominal"


def typed(df: DataFrame, types: DataFrame) -> DataFrame:
    """df with the text columns that hold numbers or dates converted; what does not parse is null."""
    kind = {r["column"]: r["semantic_type"] for r in types.collect()}  # one row a column
    new = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            if kind.get(f.name) == "datetime":
                new[f.name] = to_timestamp(f"`{f.name}`")
            elif (kind.get(f.name) or "").startswith("numeric"):
                new[f.name] = numeric_text(F.col(f"`{f.name}`"))
    return df.withColumns(new)


MEASURES = "variable string, mean double, std double, min double, q1 double, median double, q3 double, max double, skewness double, kurtosis double, zeros long, negatives long, outliers long, outlier_share double"


def profile_columns(df: DataFrame) -> DataFrame:
    """One row a column: gaps, distinct values, the dominant value, moments, quartiles, zeros, negatives, outliers, words, first and last date."""
    base = column_counts(df, df.columns)
    there = F.col("rows") - F.col("missing")
    share = F.try_divide("most", there)
    got = base.select(
        "variable", "rows", "missing", (F.col("missing") / F.col("rows")).alias("missing_share"), "distinct", (F.col("distinct") / F.col("rows")).alias("distinct_share"), F.try_divide("distinct", there).alias("cardinality"),
        "dominant", share.alias("dominant_share"), (F.col("distinct") <= 1).alias("constant"), F.coalesce((share >= THRESHOLDS["near_constant"]) & (F.col("distinct") > 1), F.lit(False)).alias("near_constant"),
    )
    spark = df.sparkSession
    numeric = [f.name for f in df.schema.fields if _is_numeric(f)]
    q = quantiles(df, numeric, [0.25, 0.5, 0.75]) if numeric else {}
    agg = []
    for c in numeric:
        v, (lo, _, hi) = clean(c), q[c] or (0.0, 0.0, 0.0)
        reach, count = 1.5 * (hi - lo), F.count(v).cast("double")
        out = F.count_if((v < lo - reach) | (v > hi + reach)) if hi > lo else F.lit(0).cast("long")
        agg.append(F.struct(F.avg(v), F.stddev_samp(v), F.min(v), F.max(v), sample_skew(count, F.skewness(v)), sample_kurtosis(count, F.kurtosis(v)), F.count_if(v == 0), F.count_if(v < 0), out, F.try_divide(out, count)).alias(c))
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    agg += [F.avg(F.size(F.split(F.trim(F.col(c)), r"\s+"))).alias(f"words|{c}") for c in texts]
    agg += [F.struct(F.min(c).cast("string"), F.max(c).cast("string")).alias(f"dates|{c}") for c in dates]
    row: dict = {}
    for a in range(0, len(agg), 2):  # the measures of two columns make code enough for one pass
        row |= df.agg(*agg[a : a + 2]).first().asDict()
    rows = []
    for c in numeric:
        mean, std, low, high, skew, kurt, *counts = row[c]
        rows.append((c, mean, std, low, *(q[c] or [None] * 3), high, skew, kurt, *counts))
    got = got.join(spark.createDataFrame(rows, MEASURES), "variable", "left")
    got = got.join(spark.createDataFrame([(c, row[f"words|{c}"]) for c in texts], "variable string, mean_words double"), "variable", "left")
    return got.join(spark.createDataFrame([(c, *row[f"dates|{c}"]) for c in dates], "variable string, first string, last string"), "variable", "left")


def date_frequency(df: DataFrame, cols: list[str]) -> DataFrame:
    """(variable, spacing, frequency, missing_periods) of date columns, from the gaps between their different days."""
    from tesserae.operators.series import frequency_label

    x = value_counts(df.select(*[F.to_date(c).alias(c) for c in cols]), cols).where("value is not null").select("variable", F.to_date("value").alias("t"))
    x = x.withColumn("gap", F.datediff("t", F.lag("t").over(Window.partitionBy("variable").orderBy("t"))))  # different days of a column
    g = x.groupBy("variable").agg(F.count(F.lit(1)).alias("days"), F.datediff(F.max("t"), F.min("t")).alias("span"))
    g = g.where("days >= 3").join(group_quantiles(x, ["variable"], "gap", [0.5]).select("variable", F.col("q")[0].alias("spacing")), "variable")
    return g.select("variable", "spacing", frequency_label(F.col("spacing")).alias("frequency"), F.greatest(F.floor(F.col("span") / F.col("spacing")) + 1 - F.col("days"), F.lit(0)).cast("long").alias("missing_periods"))


def leakage_suspects(df: DataFrame, target: str | None = None, limit: float = THRESHOLDS["leakage"]) -> DataFrame:
    """(column, reason, r): a leaky name, or a correlation with the target at or over the limit."""
    out = [(c, "name", None) for c in df.columns if c != target and re.search(LEAK_NAME, c)]
    numeric = [f.name for f in df.schema.fields if _is_numeric(f) and f.name != target]
    if target and numeric:
        row = df.agg(*[safe_corr(clean(c), clean(target)).alias(c) for c in numeric]).first()
        out += [(c, "correlation", float(row[c])) for c in numeric if row[c] is not None and abs(row[c]) >= limit]
    return df.sparkSession.createDataFrame(out, "column string, reason string, r double")


def target_candidates(df: DataFrame, types: DataFrame, profile: DataFrame) -> DataFrame:
    """(column, semantic_type, task, score) of plausible outcomes, ten at most: name, kind, few gaps, last column, some variation."""
    x = types.join(profile.withColumnRenamed("variable", "column"), "column").where(~F.col("semantic_type").isin("identifier", "constant", "text", "datetime"))
    kind, gaps = F.col("semantic_type"), F.col("missing_share")
    score = (
        F.when(F.col("column").rlike(TARGET_NAME), 0.35).otherwise(0.0)
        + F.when(kind == "binary", 0.25).when(kind == "numeric_continuous", 0.20).when((kind == "categorical_nominal") & (F.col("distinct") <= 10), 0.15).otherwise(0.0)
        + F.when(gaps == 0, 0.10).when(gaps > 0.3, -0.20).otherwise(0.0)
        + F.when(F.col("column") == df.columns[-1], 0.08).otherwise(0.0)
        - F.when(F.col("near_constant"), 0.4).otherwise(0.0)
    )
    many = kind.isin("categorical_nominal", "categorical_ordinal") | ((kind == "numeric_discrete") & (F.col("distinct") <= 10))
    task = F.when(kind == "binary", "binary_classification").when(many, "multiclass_classification").otherwise("regression")
    got = x.select("column", "semantic_type", task.alias("task"), F.round(F.least(score, F.lit(1.0)), 3).alias("score"))
    return got.where("score > 0").orderBy(F.desc("score"), "column").limit(10)


ISSUE = "code string, column string, severity string"


def quality_issues(types: DataFrame, profile: DataFrame, duplicates: int = 0, rows: int = 0, pairs: DataFrame | None = None, inflation: DataFrame | None = None, suspects: DataFrame | None = None) -> DataFrame:
    """(code, column, severity) by rules over the profile; issues of the whole table have no column.

    rows: of the table (0: not judged); pairs: correlation_pairs; inflation: vif; suspects: leakage_suspects.
    """
    t, spark = THRESHOLDS, types.sparkSession
    x = types.join(profile.withColumnRenamed("variable", "column"), "column")
    share, kind = F.col("missing_share"), F.col("semantic_type")
    rules = [
        ("severe_missingness", "critical", share >= t["missing_critical"]),
        ("missing_values", "warning", (share >= t["missing_warning"]) & (share < t["missing_critical"])),
        ("constant_columns", "info", F.col("constant")),
        ("near_constant_columns", "info", F.col("near_constant")),
        ("outliers", "warning", F.col("outlier_share") >= t["outlier_share"]),
        ("skewed_distributions", "info", F.abs("skewness") > t["skew"]),
        ("high_cardinality", "warning", kind == "high_cardinality_categorical"),
        ("identifier_columns", "info", kind == "identifier"),
    ]
    numeric = kind.startswith("numeric")
    rules = [(c, s, numeric & w if c in ("outliers", "skewed_distributions") else w) for c, s, w in rules]
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, when in rules]))
    got = x.select("column", F.inline(found)).select("code", "column", "severity")
    table = []
    if rows and rows < t["small_sample"]:
        table.append(("small_sample", None, "critical" if rows < 30 else "warning"))
    if rows and types.count() / rows > t["wide_data"]:
        table.append(("wide_data", None, "warning"))
    if duplicates:
        table.append(("duplicate_rows", None, "warning" if duplicates < 0.05 * rows else "critical"))
    got = got.unionAll(spark.createDataFrame(table, ISSUE))
    if pairs is not None:
        strong = pairs.where(F.abs("r") >= t["correlation"])
        got = got.unionAll(strong.select(F.explode(F.array("a", "b")).alias("column")).distinct().select(F.lit("high_correlation"), "column", F.lit("warning")))
    if inflation is not None:
        bad = inflation.where(F.col("vif") >= t["vif_warning"]).select("variable", F.max("vif").over(Window.partitionBy()).alias("worst"))  # one row a column
        got = got.unionAll(bad.select(F.lit("multicollinearity"), "variable", F.when(F.col("worst") >= t["vif_critical"], "critical").otherwise("warning")))
    if suspects is not None:
        worst = F.max((F.col("reason") == "correlation").cast("int")).over(Window.partitionBy())  # one row a suspect
        got = got.unionAll(suspects.withColumn("w", worst).select(F.lit("possible_leakage"), "column", F.when(F.col("w") > 0, "critical").otherwise("warning")).distinct())
    return got


def quality_score(issues: DataFrame) -> DataFrame:
    """100 less a penalty for each code that was found, and the number of codes."""
    codes = issues.select("code", "severity").distinct()
    cost = chain([(F.col("severity") == k, v) for k, v in PENALTY.items()], 0)
    return codes.agg(F.greatest(F.lit(0), 100 - F.coalesce(F.sum(cost), F.lit(0))).cast("long").alias("score"), F.count(F.lit(1)).alias("issues"))


def dimension_scores(issues: DataFrame) -> DataFrame:
    """(dimension, score, issues): 100 less a penalty for each of its codes; 100 says that nothing was found."""
    codes = issues.select("code", "severity").distinct()
    cost = chain([(F.col("severity") == k, v) for k, v in DIMENSION_PENALTY.items()], 0)
    names = issues.sparkSession.createDataFrame([(d, c) for d, own in DIMENSIONS.items() for c in own], "dimension string, code string")
    g = names.join(codes, "code", "left").groupBy("dimension").agg(F.sum(F.when(F.col("severity").isNotNull(), cost).otherwise(0)).alias("p"), F.count("severity").alias("issues"))
    return g.select("dimension", F.greatest(F.lit(0), 100 - F.col("p")).cast("long").alias("score"), "issues")


def all_issues(df: DataFrame, target: str | None = None) -> DataFrame:
    """quality_issues with everything they can rest on."""
    types = infer_semantic_types(df)
    kinds = {r["column"]: r["semantic_type"] for r in types.collect()}  # one row a column
    numeric = [c for c, k in kinds.items() if k.startswith("numeric") and _is_numeric(df.schema[c])]
    counted = count_duplicates(df).first()
    many = len(numeric) > 1
    return quality_issues(types, profile_columns(df), counted["duplicates"], counted["rows"], correlation_pairs(df, numeric) if many else None, vif(df, [c for c in numeric if c != target]) if many else None, leakage_suspects(df, target))


def profile_dataset(df: DataFrame) -> DataFrame:
    """Types and measures of every column, one row each."""
    return infer_semantic_types(df).join(profile_columns(df).withColumnRenamed("variable", "column"), "column")


def drop_useless_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """Without identifiers, constants, near-constants and critical leakage suspects."""
    p = profile_dataset(df).where(F.col("semantic_type").isin("identifier", "constant") | F.col("near_constant"))
    gone = {r["column"] for r in p.select("column").collect()}
    if target:
        gone |= {r["column"] for r in leakage_suspects(df, target).where("reason = 'correlation'").select("column").collect()}
    return df.drop(*[c for c in gone if c != target])
