"""Four shared passes: value counts, quantiles, global ranks, Gram matrix."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.scalar import clean
from tesserae.sources.written import written


def long_form(df: DataFrame, cols: list[str], *keep: str, cast: str = "string") -> DataFrame:
    """(keep..., variable, value): one row for each column, without a pass for each."""
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast(cast).alias("value")) for c in cols])))


def safe_corr(a, b):
    """Pearson's r over the rows where both are there; null where one is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(variable, value, n) of all columns from one shuffle."""
    return long_form(df, cols).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))


#: Approximate distinct values up to which a column's values are counted outright; items that a summary keeps and those it reports.
COUNTED, SUMMARY, REPORTED = 10_000, 10_000, 20
#: Bits of a bitmap for each expected value, up to which whole numbers are counted by bitmaps.
SPARSE = 64
#: Rows up to which one count of all values is less work than the passes that would spare it.
OUTRIGHT = 2_000_000


def column_counts(df: DataFrame, cols: list[str], mode: bool = True) -> DataFrame:
    """(variable, rows, missing, distinct, and with mode: most, dominant), exact; dominant is the least of the most frequent values, as text.

    A column is handled by what one aggregate says of it. Few values: they are counted. Many: whole numbers
    without large gaps are told apart by bitmaps, so that no value is shuffled; where all are different, or a summary
    of frequent items proves that the rest cannot reach the best of them, only the few survivors are
    counted. What is left (many values, none of them frequent) is counted value by value.
    """
    spark = df.sparkSession
    whole = [isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for c in cols]
    col = [F.col(f"`{c}`") for c in cols]
    rows = df.count()
    if rows <= OUTRIGHT:
        there, near = dict.fromkeys(range(len(cols))), dict.fromkeys(range(len(cols)), 0)
    else:
        first = df.agg(*[F.struct(F.count(c), F.approx_count_distinct(c, 0.05), *([F.min(c).cast("long"), F.max(c).cast("long")] if w else [])) for c, w in zip(col, whole, strict=True)]).first()
        there, near = ({i: own[k] for i, own in enumerate(first)} for k in (0, 1))
    count = [i for i in near if near[i] <= COUNTED]
    wide = [i for i in near if near[i] > COUNTED]
    dense = [i for i in wide if whole[i] and first[i][3] - first[i][2] <= SPARSE * near[i]]
    known: dict[int, tuple] = {}  # distinct, most, dominant
    if dense:
        bits = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), col[i].cast("long").alias("v")) for i in dense]))).where("v is not null")
        bits = bits.groupBy("i", F.bitmap_bucket_number("v").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
        known = {r.i: (r.n, None, None) for r in bits.groupBy("i").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()}
        keys = [i for i in dense if known[i][0] == there[i]]
        if mode and keys:
            known |= {i: (there[i], 1, v) for i, v in zip(keys, df.agg(*[F.min(col[i].cast("string")) for i in keys]).first(), strict=True)}
    open_ = [i for i in wide if i not in known or known[i][1] is None]
    if mode and open_:
        tops = df.agg(*[F.call_function("approx_top_k", col[i], F.lit(REPORTED), F.lit(SUMMARY)) for i in open_]).first()
        best = {i: {r["item"]: r["count"] for r in top if r["item"] is not None} for i, top in zip(open_, tops, strict=True)}
        slip = {i: 3.5 * rows / (1 << math.ceil(math.log2(SUMMARY / 0.75))) for i in open_}
        # a summary overstates a count by slip at most, so one whose best stands no higher has nothing to say
        likely = [i for i in open_ if best[i] and max(best[i].values()) > 2 * slip[i]]
        if likely:
            some = [F.struct(F.lit(i).alias("i"), F.when(col[i].isin(list(best[i])), col[i].cast("string")).alias("value")) for i in likely]
            found = df.select(F.inline(F.array(*some))).where("value is not null").groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
            for r in found.groupBy("i").agg(F.max("n").alias("n"), F.min_by("value", F.struct(-F.col("n"), "value")).alias("value")).collect():
                beyond = max(slip[r.i], min(best[r.i].values()) if len(best[r.i]) >= REPORTED else 0)
                if r.n > beyond:
                    known[r.i] = (known.get(r.i, (None,))[0], r.n, r.value)
    every = [i for i in count + wide if i not in known or known[i][0] is None or mode and known[i][1] is None]
    if every:
        n, value = F.col("n"), F.col("value")
        few = [i for i in every if rows > OUTRIGHT and i in count]
        rest = [i for i in every if i not in few]
        # few values are counted as they are, and only these written as text
        parts = [df.groupBy(col[i].alias("v")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(str(i)).alias("variable"), F.col("v").cast("string").alias("value"), "n") for i in few]
        parts += [value_counts(df.select(*[col[i].alias(str(i)) for i in rest]), [str(i) for i in rest])] if rest else []
        cells = reduce(DataFrame.unionAll, parts)
        some = value.isNotNull()
        for r in cells.groupBy("variable").agg(F.sum(F.when(some, n)).alias("there"), F.count(value).alias("d"), F.max(F.when(some, n)).alias("n"), F.min_by("value", F.when(some, F.struct(-n, "value"))).alias("v")).collect():
            known[int(r.variable)], there[int(r.variable)] = (r.d, r.n, r.v), r.there or 0
    out = [(c, rows, rows - (there[i] or 0), *known.get(i, (0, None, None))) for i, c in enumerate(cols)]
    got = spark.createDataFrame(out, "variable string, rows long, missing long, distinct long, most long, dominant string")
    return got if mode else got.drop("most", "dominant")


#: Relative rank error of the sketches that bracket a quantile; values kept between brackets at most; ranges of a global rank at most, and values in one.
SKETCH, BETWEEN, RANGES, RANGE_VALUES = 5e-4, 1_000_000, 1024, 200_000


def edges_below(value, edges: list, first: int = 0):
    """first plus the number of edges below the value, by halving: a few comparisons in generated code."""
    if not edges:
        return F.lit(first)
    m = len(edges) // 2
    return F.when(value > F.lit(edges[m]), edges_below(value, edges[m + 1 :], first + m + 1)).otherwise(edges_below(value, edges[:m], first))


def _between(value, edges: list[float], first: int = 0):
    """2 i for a value equal to edges[i], 2 i + 1 for one between edges[i] and edges[i + 1]; no value is below the first or above the last."""
    if len(edges) == 1:
        return F.when(value == F.lit(edges[0]), 2 * first).otherwise(2 * first + 1)
    m = len(edges) // 2
    return F.when(value >= F.lit(edges[m]), _between(value, edges[m:], first + m)).otherwise(_between(value, edges[:m], first))


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float] | None]:
    """Exact quantiles (linear between neighbours) of all columns; a few numbers reach the driver.

    A sketch brackets each order statistic, one pass counts what lies below each bracket and the values
    inside, and running sums over these few pick the statistic. Where a bracket still holds very many
    values, or misses, it is sketched again inside. No task holds all values of a column.
    """
    if len(probs) > MANY:
        return {c: _many_quantiles(df, c, probs) for c in cols}
    at_once = max(1, 16 // (2 * len(probs) + 2))  # columns whose comparisons make one piece of generated code, small enough to be compiled
    if len(cols) > at_once:
        return {c: q for a in range(0, len(cols), at_once) for c, q in quantiles(df, cols[a : a + at_once], probs).items()}
    x = df.select(*[clean(c).alias(f"c{i}") for i, c in enumerate(cols)])
    grid = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-2 * SKETCH, 2 * SKETCH)} | {0.0, 1.0})
    accuracy = round(1 / SKETCH)
    first = x.agg(*[F.struct(F.count(f"c{i}"), F.percentile_approx(f"c{i}", grid, accuracy)) for i in range(len(cols))]).first()
    n, edges, found, wide, narrow = {}, {}, {}, {}, {}
    for i, (count, q) in enumerate(first):
        n[i], edges[i], found[i] = count, sorted(set(q or [])), {}
        at = dict(zip(grid, q or [], strict=False))
        narrow[i] = _brackets(edges[i], [(at[max(0.0, p - 2 * SKETCH)], at[min(1.0, p + 2 * SKETCH)]) for p in probs] if at else [])
        wide[i] = len(probs) * 4 * SKETCH * count > BETWEEN  # too many values to keep: count first
    wanted = {i: sorted({k for p in probs for k in (int(p * (n[i] - 1)), min(int(p * (n[i] - 1)) + 1, n[i] - 1))}) for i in n if n[i]}
    while True:
        left = {i: [k for k in wanted[i] if k not in found[i]] for i in wanted}
        left = {i: k for i, k in left.items() if k}
        if not left:
            break
        rows = []
        for i in left:
            v, e = F.col(f"c{i}"), edges[i]
            slot = _between(v, e)
            keep = slot.isin([2 * e.index(a) + 1 for a in narrow[i] if a in e]) if not wide[i] else F.lit(False)
            rows.append(F.struct(F.lit(i).alias("i"), slot.alias("slot"), F.when(keep, v).alias("v"), v.isNotNull().alias("there")))
        cells = x.select(F.inline(F.array(*rows))).where("there").groupBy("i", "slot", "v").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("i").orderBy("slot", "v")  # over the edges and the values in brackets
        cells = cells.withColumn("upto", F.sum("n").over(w))
        goal = F.create_map(*[y for i, k in left.items() for y in (F.lit(i), F.array(*[F.lit(z) for z in k]))])[F.col("i")]
        hit = cells.where(F.exists(goal, lambda k: (k >= F.col("upto") - F.col("n")) & (k < F.col("upto")))).collect()
        again: dict[int, list] = {}
        for r in hit:
            for k in left[r.i]:
                if r.upto - r.n <= k < r.upto:
                    if r.slot % 2 == 0:
                        found[r.i][k] = edges[r.i][r.slot // 2]
                    elif r.v is not None:
                        found[r.i][k] = r.v
                    else:
                        again.setdefault(r.i, []).append((r.slot // 2, (k - (r.upto - r.n)) / r.n, r.n))
        if again:
            asked = [(i, j, a, m) for i, own in again.items() for j, a, m in own]
            sketch = x.agg(*[F.percentile_approx(F.when((F.col(f"c{i}") > edges[i][j]) & (F.col(f"c{i}") < edges[i][j + 1]), F.col(f"c{i}")), [max(0.0, a - 2 * SKETCH), min(1.0, a + 2 * SKETCH)], accuracy) for i, j, a, _ in asked]).first()
            spans: dict[int, list] = {}
            for (i, _, _, _), q in zip(asked, sketch, strict=True):
                spans.setdefault(i, []).append((q[0], q[1]))
            for i, own in again.items():
                edges[i] = sorted({*edges[i], *[e for span in spans[i] for e in span]})
                narrow[i], wide[i] = _brackets(edges[i], spans[i]), 4 * SKETCH * sum(m for _, _, m in own) > BETWEEN
    out: dict[str, list[float] | None] = {}
    for i, c in enumerate(cols):
        if not n[i]:
            out[c] = None
            continue
        q = []
        for p in probs:
            k = int(p * (n[i] - 1))
            a, b = found[i][k], found[i][min(k + 1, n[i] - 1)]
            here = p * (n[i] - 1)
            q.append((k + 1 - here) * a + (here - k) * b if b != a else a)
        out[c] = q
    return out


#: Probabilities beyond which order statistics are looked for in ranges of a fine grid; ranges of that grid.
MANY, GRID = 20, 4096


def places(df: DataFrame, value, edges: list[float], name: str) -> DataFrame:
    """df with how many of the sorted edges are no greater than a value; null without one. Halving in one function: its code does not grow with the edges."""
    splits = [-math.inf, *[e + 0.0 for e in edges], math.inf]  # no -0.0, which halving would put before 0.0
    got = Bucketizer(splits=splits, inputCol="_at", outputCol=name, handleInvalid="keep").transform(df.withColumn("_at", value + F.lit(0.0)))
    return got.withColumn(name, F.when(F.col("_at").isNotNull(), F.col(name).cast("int"))).drop("_at")


def _many_quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float] | None:
    """Exact quantiles of one column for very many probabilities.

    A sketch cuts the values into GRID ranges, one pass counts each range, and only the ranges that hold a
    wanted order statistic are counted value by value, each by itself.
    """
    x = df.select(clean(col).alias("v")).where("v is not null")
    edges = sorted(set(x.agg(F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], 2 * GRID)).first()[0] or []))
    if not edges:
        return None
    x = places(x, F.col("v"), edges, "slot")
    sizes = {r["slot"]: r["n"] for r in x.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    n = sum(sizes.values())
    wanted = sorted({k for p in probs for k in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))})
    goals: dict[int, list[int]] = {}  # the range of each order statistic and its place there
    todo, before = iter(wanted), 0
    k = next(todo, None)
    for slot in sorted(sizes):
        while k is not None and k < before + sizes[slot]:
            goals.setdefault(slot, []).append(k - before)
            k = next(todo, None)
        before += sizes[slot]
    goal = df.sparkSession.createDataFrame(list(goals.items()), "slot int, goal array<long>")  # a row a range
    cells = x.where(F.col("slot").isin(list(goals))).groupBy("slot", "v").agg(F.count(F.lit(1)).alias("n")).join(goal, "slot")
    cells = cells.withColumn("upto", F.sum("n").over(Window.partitionBy("slot").orderBy("v")))
    hit = cells.select("slot", "v", F.explode(F.filter("goal", lambda k: (k >= F.col("upto") - F.col("n")) & (k < F.col("upto")))).alias("k")).collect()  # one row an order statistic
    at = {(r["slot"], r["k"]): r["v"] for r in hit}
    value = dict(zip(wanted, [at[slot, k] for slot in sorted(goals) for k in goals[slot]], strict=True))
    q = []
    for p in probs:
        k = int(p * (n - 1))
        a, b = value[k], value[min(k + 1, n - 1)]
        q.append((k + 1 - p * (n - 1)) * a + (p * (n - 1) - k) * b if b != a else a)
    return q


def _brackets(edges: list[float], spans: list[tuple[float, float]]) -> set[float]:
    """The lower edges of the stretches between neighbouring edges that lie in one of the spans."""
    return {a for a, b in zip(edges[:-1], edges[1:], strict=True) if any(x <= a and b <= y for x, y in spans)}


def running_counts(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """counts (by..., value, n), one row for each value of a group, with the rows before it and total, those of its group.

    Values are dealt in the order of group and value to ranges of about RANGE_VALUES, whose edges Spark
    takes from a sample, so a group with very many values lies in several ranges. Sums run inside a
    group's part of a range, and the parts' totals (one row each) are added.
    """
    held = written(counts)
    parts = math.ceil(max(held.count(), 1) / RANGE_VALUES)
    if parts > 1:
        dealt = written(held.repartitionByRange(parts, *by, value).withColumn("_b", F.spark_partition_id()))
    else:
        dealt = held.withColumn("_b", F.lit(0))
    totals = dealt.groupBy(*by, "_b").agg(F.sum("n").alias("_t"))  # a row for each range that a group touches
    own = Window.partitionBy(*by)
    offsets = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_o"), (F.sum("_t").over(own.orderBy("_b")) - F.col("_t")).alias("_f"), F.sum("_t").over(own).alias("total"))
    within = F.sum("n").over(Window.partitionBy(*by, "_b").orderBy(value)) - F.col("n")
    same = F.col("_b") == F.col("_o")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    got = dealt.withColumn("_w", within).join(offsets, same)
    return got.select(*by, value, "n", (F.col("_f") + F.col("_w")).alias("before"), "total")


def group_quantiles(df: DataFrame, by: list[str], col, probs: list[float]) -> DataFrame:
    """(by..., q): exact quantiles of each group, however many values one group has."""
    v = F.col(col) if isinstance(col, str) else col
    cells = df.select(*by, v.cast("double").alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("n"))
    cells = running_counts(cells, by, "_v").select(*by, "_v", F.col("n").alias("_n"), (F.col("before") + F.col("n")).alias("_u"), F.col("total").alias("_t"))
    place = lambda p: F.lit(float(p)) * (F.col("_t") - 1)

    def at(k):
        return F.max(F.when((F.col("_u") - F.col("_n") <= k) & (k < F.col("_u")), F.col("_v")))

    pieces = []
    for j, p in enumerate(probs):
        low = F.floor(place(p))
        pieces += [at(low).alias(f"_a{j}"), at(F.least(low + 1, F.col("_t") - 1)).alias(f"_b{j}"), F.max(place(p) - low).alias(f"_f{j}")]
    got = cells.groupBy(*by).agg(*pieces)
    q = F.array(*[F.when(F.col(f"_a{j}") == F.col(f"_b{j}"), F.col(f"_a{j}")).otherwise((1 - F.col(f"_f{j}")) * F.col(f"_a{j}") + F.col(f"_f{j}") * F.col(f"_b{j}")) for j in range(len(probs))])
    return got.select(*by, q.alias("q"))


def range_edges(df: DataFrame, col: str) -> list:
    """Values that cut df into ranges of about RANGE_VALUES rows; their number follows the rows'."""
    n, q = df.agg(F.count(col), F.percentile_approx(col, [i / RANGES for i in range(1, RANGES)], 2 * RANGES)).first()
    every = max(1, RANGES * RANGE_VALUES // max(n, 1))
    return sorted(set((q or [])[every - 1 :: every]))


def global_ranks(df: DataFrame, col: str, *, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by..., col, n, before, rank): for each different value its count, the rows below it and its average rank.

    weight: a column with the number of rows that each row stands for.

    No window runs over all rows: values are counted, dealt to ranges by literal edges, counted up
    inside each range, and the ranges' own totals (one row each) are added.
    """
    by = by or []
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    if by:
        return running_counts(counts, by, col).drop("total").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    counts = counts.withColumn("_b", edges_below(F.col(col), range_edges(df, col)))
    totals = counts.groupBy("_b").agg(F.sum("n").alias("_t"))
    offsets = totals.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_o"))  # one row a range
    w = Window.partitionBy("_b").orderBy(col)
    got = counts.withColumn("_c", F.sum("n").over(w) - F.col("n")).join(offsets, "_b")
    return got.select(col, "n", (F.col("_o") + F.col("_c")).alias("before")).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)


def gram(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, centred sums of products) over rows complete in cols: two aggregates, p * p numbers to the driver."""
    x = df.select(*[clean(c).alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    p = len(cols)
    first = x.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(p)]).first()
    n = first["n"]
    means = np.array([first[f"m{i}"] or 0.0 for i in range(p)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = x.agg(*[F.sum((F.col(f"c{i}") - float(means[i])) * (F.col(f"c{j}") - float(means[j]))) for i, j in pairs]).first()
    s = np.zeros((p, p))
    for (i, j), v in zip(pairs, row, strict=True):
        s[i, j] = s[j, i] = v or 0.0
    return n, means, s


def gram_by(df: DataFrame, cols: list[str], by: str) -> list[tuple]:
    """(level, n, means, centred sums of products) for each level of by, in order, from one aggregate; p * p numbers a level to the driver."""
    x = df.where(F.col(by).isNotNull()).select(F.col(by).alias("_g"), *[clean(c).alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = x.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(f"c{i}") for i in range(p)]).alias("m"), F.array(*[F.covar_pop(f"c{i}", f"c{j}") for i, j in pairs]).alias("s")).orderBy("_g").collect()
    out = []
    for r in rows:
        s = np.zeros((p, p))
        for (i, j), v in zip(pairs, r.s, strict=True):
            s[i, j] = s[j, i] = (v or 0.0) * r.n
        out.append((r._g, r.n, np.array(r.m, dtype=float), s))
    return out
