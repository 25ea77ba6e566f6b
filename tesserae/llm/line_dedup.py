"""Line dedup by overlapping three-line windows. DataFrame operations only.

A window is three consecutive lines of one document. Windows are hashed, repeated ones are found
over all documents by a grouped minimum, and each window but the first (by doc_id, then by place)
covers its three lines; covered lines are removed. Overlapping windows merge because only the
stretches between their starts are kept.

Defined results: lines are split at "\\n" and compared exactly; a document of under three lines has
no window and stays; a null text is empty (one empty line); a null doc_id comes last; rows alike in
doc_id and text are one document and get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import documents, keyed, materialize

#: Lines in a window.
LINES = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, n: int = LINES) -> DataFrame:
    """ord, th, pos (of the window's first line, from 0) and two hashes of its lines."""
    hashed = docs.select(
        "ord",
        "th",
        F.transform(lines_of(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))).alias("h"),
    ).where(F.size("h") >= n)
    places = F.sequence(F.lit(1), F.size("h") - (n - 1))
    each = F.transform(places, lambda i: F.struct((i - 1).alias("pos"), F.slice("h", i, n).alias("w")))
    w = hashed.select("ord", "th", F.inline(each))
    return w.select("ord", "th", "pos", F.xxhash64("w.a").alias("wa"), F.xxhash64("w.b").alias("wb"))


def later_windows(docs: DataFrame, n: int = LINES) -> DataFrame:
    """The starts of windows that occurred before, as one sorted array for each document.

    The minimum is taken before the shuffle as well, so a window that a third of all rows hold
    costs one row a task; the repeated ones are written, and the join back has one row for each of them,
    so that Spark can split its large side.
    """
    w = windows(docs, n)
    first = w.groupBy("wa", "wb").agg(F.min(F.struct("ord", "th", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = w.join(materialize(first), ["wa", "wb"]).where(F.struct("ord", "th", "pos") > F.col("first"))
    return later.groupBy("ord", "th").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def kept_lines(lines: Column, starts: Column, n: int = LINES) -> Column:
    """The lines between the windows at starts, joined by line ends."""
    starts = F.coalesce(starts, F.array().cast("array<int>"))
    after = F.concat(F.array(F.lit(0)), F.transform(starts, lambda s: s + n))  # where each stretch may begin
    until = F.concat(starts, F.array(F.size(lines)))  # and where it ends
    stretches = F.transform(F.arrays_zip(after.alias("a"), until.alias("u")), lambda x: F.slice(lines, x["a"] + 1, F.greatest(x["u"] - x["a"], F.lit(0))))
    return F.flatten(stretches)


def dedup_lines(docs: DataFrame, *more: str, n: int = LINES) -> DataFrame:
    """doc_id, text (as kept), n_lines, n_removed and the columns in more, one row a document."""
    rows = keyed(docs, *more)
    starts = later_windows(keyed(docs), n)
    got = rows.join(starts, ["ord", "th"], "left")
    lines = lines_of(F.col("text"))
    kept = got.withColumn("kept", F.when(F.col("starts").isNull(), lines).otherwise(kept_lines(lines, F.col("starts"), n)))
    return kept.select(
        "doc_id",
        F.array_join("kept", "\n").alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size("kept")).cast("long").alias("n_removed"),
        *more,
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of the lines left, joined by line ends."""
    got = dedup_lines(documents(spark, sf_dir))
    return got.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def dedup_lines_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; a document with no line left goes."""
    names = docs.columns
    row = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in names]))
    got = dedup_lines(row, "_row").where("n_removed = 0 or n_removed < n_lines")
    changed = F.col("n_removed") > 0
    value = {"text": F.when(changed, F.col("text")).otherwise(F.col("_row.text")), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("_row.n_chars") if "n_chars" in names else F.lit(0))}
    return got.select(*[value.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names])


OP6_SQL = """
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
w as (select doc_id, unnest(range(0, len(ls) - 2)) as pos, ls from l where len(ls) >= 3),
h as (select doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] as t from w),
r as (select doc_id, pos, row_number() over (partition by t order by doc_id, pos) as rn from h),
c as (select distinct doc_id, pos + unnest([1, 2, 3]) as line from r where rn > 1),
x as (select doc_id, unnest(ls) as t, unnest(range(1, len(ls) + 1)) as line from l),
k as (select x.doc_id, x.line, x.t, c.line is not null as gone from x left join c on c.doc_id = x.doc_id and c.line = x.line)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
       sha256(coalesce(string_agg(t, chr(10) order by line) filter (not gone), '')) as kept_sha256
from k group by doc_id
"""
