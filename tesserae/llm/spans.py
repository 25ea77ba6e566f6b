"""From repeated stretches to removed spans: what phrase dedup and suffix dedup have in common.

An occurrence is a run of windows of one document around one anchor (see common.anchors): its key
(ord, th), its first and last window lo and hi, the hash of the anchor and two fingerprints of all
the units it covers, its context. Occurrences alike in context need one comparison only: all but the
first are later copies. Different contexts around one anchor can still share some windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import materialize

OCCURRENCE = "ord long, th long, hash long, lo int, hi int, fp1 long, fp2 long"


def unique_texts(keyed_docs: DataFrame) -> DataFrame:
    """One row for each (ord, th), combined before the shuffle, so that repeated rows cost nothing later."""
    return keyed_docs.groupBy("ord", "th").agg(F.first("text").alias("text"))


def contexts(occurrences: DataFrame) -> DataFrame:
    """One row a context: cid, hash, fp1, fp2, its first occurrence (ord, th, lo, hi) and around (contexts that share the anchor)."""
    first = F.min(F.struct("ord", "th", "lo", "hi")).alias("home")
    ctx = occurrences.groupBy("hash", "fp1", "fp2").agg(first).select("hash", "fp1", "fp2", "home.*")
    ctx = materialize(ctx)
    around = materialize(ctx.groupBy("hash").agg(F.count(F.lit(1)).alias("around")))
    return materialize(ctx.join(around, "hash").withColumn("cid", F.monotonically_increasing_id()))


def homes(ctx: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents with the contexts that begin in them and are not alone: ord, th, text, own (cid, hash, lo, hi, around)."""
    own = ctx.where("around > 1").groupBy("ord", "th").agg(F.collect_list(F.struct("cid", "hash", "lo", "hi", "around")).alias("own"))
    return unique_texts(docs).join(own, ["ord", "th"])


def gone_by_hash(windows: DataFrame, key: list[str]) -> DataFrame:
    """(cid, gone): the windows of each context, counted from its lo, that occur under a lesser key.

    The minima are written before the join, here and elsewhere: joined where they are made they would
    tie the large side to one exchange, and Spark could not split a common window's rows.

    windows: w1, w2 (hashes of the window's units), cid, rel and the columns in key. A grouped minimum
    and a join back, so that a window of very many contexts is no task of its own.
    """
    k = F.struct(*key)
    least = windows.groupBy("w1", "w2").agg(F.min(k).alias("least"), F.max(k).alias("most")).where("least < most").drop("most")
    later = windows.join(materialize(least), ["w1", "w2"]).where(k > F.col("least"))
    return later.groupBy("cid").agg(F.collect_set("rel").alias("gone"))


def spans(occurrences: DataFrame, ctx: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """(ord, th, spans): for each document its removed runs of windows (lo, hi, gone); gone null: all of them."""
    first = ctx.join(gone, "cid", "left").select("hash", "fp1", "fp2", F.struct(*key).alias("home"), "gone")
    got = occurrences.join(first, ["hash", "fp1", "fp2"])
    later = F.struct(*key) > F.col("home")
    got = got.where(later | F.col("gone").isNotNull())
    run = F.struct("lo", "hi", F.when(~later, F.col("gone")).alias("gone"))
    return got.groupBy("ord", "th").agg(F.collect_set(run).alias("spans"))


def covered(runs: list[dict] | None, window: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal covered stretches of one document of n units."""
    begin, end = [], []
    for r in runs or ():
        if r["gone"] is None:
            begin.append(r["lo"])
            end.append(r["hi"] + window)
        else:
            begin += [r["lo"] + x for x in r["gone"]]
            end += [r["lo"] + x + window for x in r["gone"]]
    if not begin:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    b, e = np.array(begin, dtype=np.int64), np.array(end, dtype=np.int64)
    order = np.argsort(b, kind="stable")
    b, e = b[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(np.concatenate(([True], b[1:] > e[:-1])))
    return b[new], np.minimum(e[np.concatenate((new[1:], [len(b)])) - 1], n)
