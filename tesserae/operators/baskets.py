"""Baskets: layout, building, frequent itemsets, rules with consequents of any size."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.written import written


def basket_layout(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, layout): delimited text, a 0/1 flag, or long identifiers; one aggregate."""
    row = df.agg(*[F.struct(F.avg(F.col(c).cast("string").rlike("[,;|]").cast("double")), F.avg(F.col(c).cast("string").isin("0", "1", "true", "false").cast("double")), F.approx_count_distinct(c)).alias(c) for c in cols]).first()
    out = [(c, "delimited" if (row[c][0] or 0) > 0.5 else "wide" if row[c][1] == 1 else "long", row[c][2]) for c in cols]
    return df.sparkSession.createDataFrame(out, "column string, layout string, distinct long")


def split_items(df: DataFrame, txn: str, items: str) -> DataFrame:
    return df.select(F.col(txn).alias("txn"), F.explode(F.array_distinct(F.filter(F.transform(F.split(items, "[,;|]"), F.trim), lambda x: x != ""))).alias("item"))


def basket_build(df: DataFrame, txn: str, item: str, most_items: int | None = 500, least: float = 0.0) -> DataFrame:
    """(txn, items): sets of the most frequent items; rarer ones go, with their number fixed by most_items (None: all stay)."""
    x = written(df.select(F.col(txn).alias("txn"), F.col(item).cast("string").alias("item")).dropna().distinct())  # read three times
    n = x.select("txn").distinct().count() if least > 0 else 0
    top = x.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least * n)
    if most_items is not None:
        top = top.orderBy(F.desc("n"), "item").limit(most_items)
    return x.join(top.select("item"), "item", "left_semi").groupBy("txn").agg(F.array_sort(F.collect_set("item")).alias("items"))


#: Candidates counted in one pass over the bitmaps, and in one step of a task.
CANDIDATES, STEP = 1_000_000, 1024
#: Transactions of a bitmap, as Spark's bitmap functions have it.
BITS = 32_768


def item_bitmaps(baskets: DataFrame, frequent: DataFrame) -> DataFrame:
    """(block, item, bits): for each block of transactions and frequent item (item, name), which of them hold it."""
    rows = baskets.select("id", F.explode(F.array_distinct("items")).alias("name")).join(frequent.select("item", "name"), "name")
    place = F.pmod("id", F.lit(BITS))
    return rows.groupBy(F.floor(F.col("id") / BITS).alias("block"), "item").agg(F.bitmap_construct_agg(place).alias("bits"))


def next_candidates(sets: np.ndarray) -> np.ndarray:
    """The sets of one more item all of whose subsets are among these; rows are ascending numbers, in order."""
    k = sets.shape[1]
    _, first, count = np.unique(sets[:, :-1], axis=0, return_index=True, return_counts=True) if k > 1 else (None, np.array([0]), np.array([len(sets)]))
    have, out = {s.tobytes() for s in sets}, []
    for a, n in zip(first.tolist(), count.tolist(), strict=True):
        i, j = np.triu_indices(n, 1)  # two sets with one prefix
        made = np.column_stack((sets[a + i], sets[a + j, -1]))
        for drop in range(k - 1):  # the two that were joined are known
            made = made[[s.tobytes() in have for s in np.ascontiguousarray(np.delete(made, drop, axis=1))]]
        out.append(made)
    return np.concatenate(out) if out else np.zeros((0, k + 1), dtype=sets.dtype)


def _supports(bitmaps: DataFrame, candidates: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(row of candidates, transactions) for those with so many transactions at least."""

    def run(table):
        import pyarrow as pa

        item = table.column("item").to_numpy()
        row = np.full(int(candidates.max()) + 1, len(item), dtype=np.int64)
        known = item < len(row)
        row[item[known]] = np.flatnonzero(known)
        words = np.frombuffer(b"".join(table.column("bits").to_pylist()) + bytes(BITS // 8), dtype=np.uint64).reshape(-1, BITS // 64)
        n = np.zeros(len(candidates), dtype=np.int64)
        for a in range(0, len(candidates), STEP):
            own = row[candidates[a : a + STEP]]
            both = words[own[:, 0]]
            for c in range(1, own.shape[1]):
                both = both & words[own[:, c]]
            n[a : a + STEP] = np.bitwise_count(both).sum(axis=1)
        hit = np.flatnonzero(n)
        return pa.table({"candidate": pa.array(hit), "n": pa.array(n[hit])})

    counted = bitmaps.select("block", "item", "bits").groupBy("block").applyInArrow(run, "candidate long, n long")
    return [(r.candidate, r.n) for r in counted.groupBy("candidate").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()]


def association_itemsets(baskets: DataFrame, least: float = 0.01, most: int = 3) -> DataFrame:
    """(items, n, support) of all sets of 1 to most items in a share `least` of the baskets.

    Level by level: sets of k items whose subsets are all frequent are counted on bitmaps of the
    transactions, one for each block and frequent item. The driver holds the frequent sets: their number is at most the mean
    number of sets of a basket divided by least, however many baskets there are.
    """
    spark = baskets.sparkSession
    held = written(baskets.select("items").withColumn("id", F.monotonically_increasing_id()))
    n = held.count()
    enough = max(1, math.ceil(least * n))
    ones = held.select(F.explode(F.array_distinct("items")).alias("name")).where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough)
    ones = sorted((r.name, r.n) for r in ones.collect())
    names, found = [name for name, _ in ones], [([name], k) for name, k in ones]
    if ones and most > 1:
        frequent = spark.createDataFrame(list(enumerate(names)), "item int, name string")
        bitmaps, sets = written(item_bitmaps(held, frequent)), np.arange(len(names), dtype=np.int32)[:, None]
        while len(sets) > 1 and sets.shape[1] < most:
            candidates, kept = next_candidates(sets), []
            for a in range(0, len(candidates), CANDIDATES):
                own = candidates[a : a + CANDIDATES]
                kept += [(own[i], k) for i, k in sorted(_supports(bitmaps, own, enough))]
            found += [([names[i] for i in s.tolist()], k) for s, k in kept]
            sets = np.array([s for s, _ in kept], dtype=np.int32).reshape(len(kept), sets.shape[1] + 1)
    return spark.createDataFrame(found, "items array<string>, n long").withColumn("support", F.col("n") / n)


def association_rules(itemsets: DataFrame, confidence: float = 0.3, lift: float = 1.0) -> DataFrame:
    """Every split of an itemset into antecedent and consequent, with the supports of both joined on."""
    s = itemsets.where(F.size("items") > 1)
    bits = F.sequence(F.lit(1), F.pow(F.lit(2), F.size("items")).cast("int") - 2)
    parts = s.select("items", "support", F.explode(bits).alias("b"))
    inside = lambda want: F.filter("items", lambda x, i: F.getbit(F.col("b"), i) == want)
    parts = parts.select("support", inside(1).alias("antecedent"), inside(0).alias("consequent"))
    side = itemsets.select("items", "support")
    got = parts.join(side.toDF("antecedent", "sa"), "antecedent").join(side.toDF("consequent", "sc"), "consequent")
    conf = F.col("support") / F.col("sa")
    got = got.select("antecedent", "consequent", "support", conf.alias("confidence"), (conf / F.col("sc")).alias("lift"), (F.col("support") - F.col("sa") * F.col("sc")).alias("leverage"), F.when(conf < 1, (1 - F.col("sc")) / (1 - conf)).alias("conviction"))
    return got.where((F.col("confidence") >= confidence) & (F.col("lift") >= lift))
