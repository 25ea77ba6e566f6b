"""Mixing sources to target weights with hash-threshold histograms. DataFrame operations only.

Every document has a hash. For each source, the tokens are summed by source and hash bucket; the
bucket in which the running sum passes the source's budget is the boundary, and only that bucket is
summed again by finer buckets, until one hash is left. A document is taken if its hash is at or
below its source's threshold: nothing is sorted but the sums. A target above the source's size is
met by nested budgets: each whole pass takes all, the last takes the rest by threshold.

Defined results: a null text has size 0; a null source is a source of its own, the last one; a
null doc_id is hashed like any other; rows alike in doc_id and text share a hash and are taken or
left together; an empty table gives an empty result. Other columns are carried or ignored and may
have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import documents, materialize

WEIGHTS = (5, 2, 1)
#: The most that a source is repeated.
MOST = 3
#: Hexadecimal digits of the hash that one level of the histogram resolves, and those of the hash.
DIGITS, ALL_DIGITS = 3, 15
WORD = r"[^\x20\x09-\x0D]+"


def document_hash() -> Column:
    """The first 60 bits of an md5 of the row's id and text, as hexadecimal digits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.substring(F.md5(F.concat(doc_id, F.lit("|"), F.md5(text))), 1, ALL_DIGITS)


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size in words, h and the columns in more."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), document_hash().alias("h"), *more
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: source_size and target, by filling in the order in which sources reach their cap.

    The windows run over one row for each source, not over documents.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(by_name) - 1) % n
    w = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (place + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("reach", F.lit(float(most)) * F.col("source_size") / F.col("w"))
    order = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    open_w = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    s = s.withColumn("left", left).withColumn("open_w", open_w).withColumn("rn", F.row_number().over(order))
    # the first source, in that order, whose cap is not reached fixes the rate of all that follow
    s = s.withColumn("rate", F.col("left").cast("double") / F.col("open_w"))
    s = s.withColumn("fixed", F.min(F.when(F.col("rate") <= F.col("reach"), F.struct("rn", "left", "open_w"))).over(every))
    free = F.col("rn") >= F.col("fixed.rn")
    target = F.when(free, F.col("w") * (F.col("fixed.left").cast("double") / F.col("fixed.open_w"))).otherwise(most * F.col("source_size").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, whole (passes that take all), last (the greatest hash that the last pass takes, or null)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    bounds = targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    bounds = materialize(bounds.withColumn("below", F.lit(0).cast("long")).withColumn("prefix", F.lit("")).withColumn("last", F.lit(None).cast("string")))
    for digits in range(DIGITS, ALL_DIGITS + 1, DIGITS):
        # the histogram of the boundary bucket alone; at the first level that is the whole source
        at = bounds.select(F.col("source").alias("s"), F.col("prefix"), F.col("below"), F.col("budget"))
        inside = sizes.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.substring("h", 1, digits - DIGITS) == F.col("prefix")))
        bucket = F.substring("h", 1, digits)
        hist = inside.groupBy("source", "below", "budget", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.max("h").alias("top"), (F.min("h") != F.max("h")).alias("many"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("sum", F.col("below") + F.sum("n").over(run))
        # taken whole: all buckets up to the last one that ends within the budget
        found = hist.groupBy("source").agg(
            F.max(F.when(F.col("sum") <= F.col("budget"), F.struct("bucket", "top", "sum"))).alias("in"),
            F.min(F.when(F.col("sum") > F.col("budget"), F.struct("bucket", "top", "sum", "n", "many"))).alias("edge"),
        )
        found = found.select(F.col("source").alias("s"), "in", "edge")
        edge_below = F.col("edge.sum") - F.col("edge.n")
        one = F.col("edge").isNotNull() & ~F.col("edge.many")
        nearer = one & (F.col("edge.sum") - F.col("budget") < F.col("budget") - edge_below)  # the one hash at the edge, if that comes nearer
        last = F.coalesce(F.when(nearer, F.col("edge.top")), F.col("in.top"), F.col("last"))
        nxt = F.when(F.col("edge").isNotNull() & ~one, F.col("edge.bucket"))
        bounds = bounds.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "whole", "budget", last.alias("last"), F.coalesce(edge_below, F.col("below")).alias("below"), nxt.alias("prefix")
        )
        bounds = materialize(bounds)
        if bounds.where(F.col("prefix").isNotNull()).isEmpty():
            break
    return bounds.select("source", "source_size", "target", "whole", "last")


def mix(docs: DataFrame, *more: str, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken and the columns in more, one row a document."""
    sizes = sized(docs)
    narrow = materialize(sizes)
    bounds = thresholds(narrow, source_targets(narrow, weights, most))
    rows = sized(docs, *more) if more else narrow
    b = bounds.withColumnRenamed("source", "s")
    copies = F.col("whole") + F.when(F.col("h") <= F.col("last"), 1).otherwise(0)
    copies = F.least(copies, F.lit(most)).cast("long")
    return rows.join(b, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *more)


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: each row as often as it is taken."""
    names = docs.columns
    row = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in names]))
    got = mix(row, "_row").where(F.col("copies") > 0)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return got.select("_row", copies.alias("_copy")).select("_row.*")


OP2_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))), 1, 15) as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, list_extract([5, 2, 1], ((row_number() over (order by source nulls last) - 1) % 3 + 1)::int) as w from s),
o as (select *, 3.0::double * source_size / w as reach from w),
f as (select *, sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by reach, source nulls last rows between unbounded preceding and 1 preceding), 0) as remain,
         sum(w) over () - coalesce(sum(w) over (order by reach, source nulls last rows between unbounded preceding and 1 preceding), 0) as open_w,
         row_number() over (order by reach, source nulls last) as rn from o),
g as (select *, min(case when remain::double / open_w <= reach then rn end) over () as fixed_rn from f),
k as (select remain::double / open_w as rate from g where rn = fixed_rn),
t as (select source, source_size, case when rn >= fixed_rn then w * rate else 3 * source_size::double end as target from g left join k on true),
u as (select *, case when source_size > 0 then floor(target / source_size) else 1 end::bigint as whole from t),
c as (select d.*, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size as budget,
             sum(size) over (partition by d.source order by h range between unbounded preceding and current row) as upto,
             sum(size) over (partition by d.source, h) as own
      from d join u on d.source is not distinct from u.source),
e as (select *, upto <= budget or (upto - own <= budget and upto > budget and upto - budget < budget - (upto - own)) as extra from c)
select doc_id, size, source_size, target, (size * least(whole + case when extra then 1 else 0 end, 3))::bigint as taken from e
"""
