"""Spelling variant grouping by permuterm rotations.

1. Words are counted over all whole texts (built-in expressions, combined before the shuffle).
2. Each word with its end mark `$` is rotated to every place. A rotation that begins behind a
   character and ends before it, `w[i+1:]$w[:i]`, is what all words share that have another character
   at i; the word without that character has it as a whole rotation. So replacements and indels
   are ranges of the sorted rotations with one prefix. Rotations are dealt by that prefix and sorted,
   and each group is scanned: at most one whole word and as many others as there are letters, since
   only the skipped character tells them apart.
3. A scan gives each member how many neighbours it has in the group and the best of them, never
   the pairs. Sums and maxima of these over a word's rotations are its answer.
4. Forms are followed by doubling: each round joins a word's last known form with that one's own.

Words that no word of a neighbouring length stands beside have no neighbours and are not rotated.
Rotations of words over HASHED characters travel as their SHA-256; the work for a word grows with the
square of its length.

Defined results: a null text has no words; a null doc_id counts as the empty text where a run's
checksum is taken; repeated rows count as often as they stand; ties of the best neighbour go to the
word that is first in code-point order; an empty table or one without such words gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import documents, materialize

LEAST_LENGTH, LEAST_COUNT, TIMES, SLIPS = 7, 2, 10, 31
#: Characters of a word up to which its rotations are kept as they are.
HASHED = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(w: Column) -> Column:
    """Only A-Z are lowered; words of ASCII alone take the faster way to the same result."""
    return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))


def slipped(w: Column, doc_id: Column, slips: int) -> Column:
    """w, or w without one character where slips divides the checksum of document and word."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), w).cast("binary"))
    p = F.pmod(h, F.length(w).cast("long")).cast("int")
    return F.when(h % slips == 0, F.concat(F.substring(w, F.lit(1), p), F.substring(w, p + 2, F.length(w)))).otherwise(w)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int = SLIPS) -> DataFrame:
    """word, n. Runs shorter than least_length cannot give such words and are passed over by the pattern."""
    runs = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("run")).select(slipped(lower_ascii(F.col("run")), F.col("doc_id"), slips).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """key, word, n, kind of every rotation: 1 and 2 skip a character (2: the first of a run of equal ones), 0 is the whole word's."""
    size, w = F.length("word"), F.col("word")
    lengths = words.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"))
    near = lengths.select(F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), "n").groupBy("size").agg(F.sum("n").alias("around"))
    words = words.withColumn("size", size).join(near.where("around > 1"), "size")

    def key(rest: Column, before: Column) -> Column:
        out = F.concat(rest, F.lit("$"), before)
        return F.when(size > HASHED, F.sha2(out, 256)).otherwise(out)

    def skip(i: Column) -> Column:
        again = (i > 0) & (F.substring(w, i, F.lit(1)) == F.substring(w, i + 1, F.lit(1)))
        return F.struct(key(F.substring(w, i + 2, size), F.substring(w, F.lit(1), i)).alias("key"), F.when(again, 1).otherwise(2).alias("kind"))

    def whole(i: Column) -> Column:
        return F.struct(key(F.substring(w, i + 1, size), F.substring(w, F.lit(1), i)).alias("key"), F.lit(0).alias("kind"))

    last = size - 1
    all_ = F.concat(F.transform(F.sequence(F.lit(0), last), skip), F.transform(F.sequence(F.lit(0), size), whole))
    return words.select("word", "n", F.explode(all_).alias("r")).select("r.key", "r.kind", "word", "n")


def scanned(rows: DataFrame) -> DataFrame:
    """word, near, best (n and word, as a struct to be minimised) from every group of rotations."""
    mine = F.struct((-F.col("n")).alias("m"), F.col("word").alias("w"))
    group = Window.partitionBy("key")
    # at most one whole word and one row a letter in a group, so it is small however common the words are
    ranked = (
        rows.withColumn("own", mine)
        .withColumn("skips", F.sum((F.col("kind") > 0).cast("int")).over(group))
        .withColumn("leads", F.sum((F.col("kind") == 2).cast("int")).over(group))
        .where("skips > 1 or leads = 1 and skips = 1")
        .withColumn("whole", F.min(F.when(F.col("kind") == 0, F.col("own"))).over(group))
        .withColumn("best_lead", F.min(F.when(F.col("kind") == 2, F.col("own"))).over(group))
        .withColumn("best_skip", F.min(F.when(F.col("kind") > 0, F.col("own"))).over(group))
    )
    second = F.min(F.when((F.col("kind") > 0) & (F.col("own") != F.col("best_skip")), F.col("own"))).over(group)
    ranked = ranked.withColumn("second_skip", second)
    by_whole = (F.col("kind") == 2) & F.col("whole").isNotNull()
    other = F.when(F.col("own") == F.col("best_skip"), F.col("second_skip")).otherwise(F.col("best_skip"))
    near = F.when(F.col("kind") == 0, F.col("leads")).otherwise(F.col("skips") - 1 + by_whole.cast("int"))
    best = F.when(F.col("kind") == 0, F.col("best_lead")).when(by_whole, F.least(other, F.col("whole"))).otherwise(other)
    return ranked.select("word", near.cast("long").alias("near"), best.alias("best")).where("near > 0")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form (word, form); the way is halved in each round."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        moved = materialize(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return now
        now = moved.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, slips: int = SLIPS) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row a word."""
    words = materialize(word_counts(docs, least_length, least_count, slips))
    found = scanned(rotations(words)).groupBy("word").agg(F.sum("near").alias("near"), F.min("best").alias("best"))
    known = words.join(found, "word", "left").withColumn("best_n", -F.col("best.m"))
    has = F.col("best_n") >= times * F.col("n")
    known = known.select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.w")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    known = materialize(known)
    return known.join(roots(known.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
