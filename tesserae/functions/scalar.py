"""Column helpers: rounding, text to number, text and date features, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sig(c) -> Column:
    """A double at eight significant digits, so that results do not depend on the order of a sum.

    The factor moves exact ties off the edge (languages round them differently); what is below 1e-11 is 0. Where the
    factor puts a value next to a tie, its exact binary value decides (format_string rounds the shortest decimal instead).
    """
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    y = c * F.lit(1.000000000003)
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(y))) - 7)
    tie = (F.abs(y) >= 1e8) & (F.abs(y) % (2 * unit) == unit / 2)  # a whole number between two, the lesser one even: Java takes the other
    finite = F.abs(y) < F.lit(float("inf"))
    digits = F.call_function("format_number", F.when(tie, y * (1 - 1e-12)).otherwise(y), F.lit("0.0000000E0"))
    return F.when(F.abs(c) < 1e-11, F.lit(0.0)).when(finite, digits.cast("double")).otherwise(y)


def clean(c) -> Column:
    """A numeric column as double with NaN and infinities as nulls."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def numeric_text(c) -> Column:
    """Text such as `R1,200.50` or `12 %` as a number; null where it is none."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[R$€£]", ""), r"[,\s%]", "")
    return bare.try_cast("double")


#: Wichura's AS 241: numerator and denominator around the middle and in the tails (down to shares of 1e-11), highest power first.
_MIDDLE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
_TAIL = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)


def with_normal_quantile(df: DataFrame, share: Column, name: str) -> DataFrame:
    """df with the standard normal's quantile of a share (1e-11 to 1 - 1e-11) as name; null without one."""
    df = df.withColumn("_p", share).withColumn("_q", F.col("_p") - 0.5)
    near = F.abs("_q") <= 0.425
    tail = F.sqrt(-F.log(F.least(F.col("_p"), 1 - F.col("_p")))) - 1.6
    df = df.withColumn("_r", F.when(near, 0.180625 - F.col("_q") * F.col("_q")).otherwise(tail))
    top, under, top_tail, under_tail = (reduce(lambda a, k: a * F.col("_r") + k, c[1:], F.lit(c[0])) for c in (*_MIDDLE, *_TAIL))
    return df.withColumn(name, F.when(near, F.col("_q") * top / under).otherwise(F.signum("_q") * top_tail / under_tail)).drop("_p", "_q", "_r")


def text_features(c: str) -> dict[str, Column]:
    """Characters, words, share of digits and of capitals, share of different words; null counts as empty.

    Words stand between blanks, tabs, line feeds, form feeds and carriage returns; other characters are part of a word.
    """
    t = F.coalesce(F.col(c), F.lit(""))
    words = F.filter(F.split(t, r"[ \t\n\f\r]+"), lambda w: w != "")
    n, k = F.length(t), F.size(words)
    return {
        f"{c}_chars": n.cast("long"),
        f"{c}_words": k.cast("long"),
        f"{c}_digit_share": F.coalesce(F.try_divide(F.regexp_count(t, F.lit("[0-9]")), n), F.lit(0.0)),
        f"{c}_upper_share": F.coalesce(F.try_divide(F.regexp_count(t, F.lit("[A-Z]")), n), F.lit(0.0)),
        f"{c}_unique_share": F.coalesce(F.try_divide(F.size(F.array_distinct(F.transform(words, F.lower))), k), F.lit(0.0)),
    }


def datetime_features(c: str, reference: str = "1970-01-01") -> dict[str, Column]:
    """Calendar parts of a date (Monday is 0); a null date gives zeros."""
    d = F.col(c).cast("date")
    two_pi = 6.283185307179586
    out = {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "dayofweek": F.weekday(d),
        "quarter": F.quarter(d),
        "is_month_end": (d == F.last_day(d)).cast("int"),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "days_since": F.datediff(d, F.lit(reference).cast("date")),
        "month_sin": F.sin(F.month(d) * (two_pi / 12)),
        "month_cos": F.cos(F.month(d) * (two_pi / 12)),
        "weekday_sin": F.sin(F.weekday(d) * (two_pi / 7)),
        "weekday_cos": F.cos(F.weekday(d) * (two_pi / 7)),
    }
    return {f"{c}_{k}": F.coalesce(v, F.lit(0)) for k, v in out.items()}


def row_aggregates(cols: list[str], prefix: str = "row") -> dict[str, Column]:
    """Sum, mean, sample deviation, least, greatest and range across columns; nulls are skipped."""
    kept = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    n = F.size(kept)
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, n)
    square = F.aggregate(kept, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    low, high = F.array_min(kept), F.array_max(kept)
    return {f"{prefix}_sum": total, f"{prefix}_mean": mean, f"{prefix}_std": F.sqrt(F.try_divide(square, n - 1)), f"{prefix}_min": low, f"{prefix}_max": high, f"{prefix}_range": high - low}


def chain(cases: list[tuple[Column, object]], otherwise) -> Column:
    """when ... when ... otherwise."""
    first, *rest = cases
    return reduce(lambda a, x: a.when(x[0], x[1]), rest, F.when(*first)).otherwise(otherwise)


def strength(r) -> Column:
    """The reading of a correlation."""
    a = F.abs(F.col(r) if isinstance(r, str) else r)
    return chain([(a < 0.1, "negligible"), (a < 0.3, "weak"), (a < 0.5, "moderate"), (a < 0.7, "strong")], "very strong")
