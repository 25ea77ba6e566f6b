"""Exact nearest neighbours of all rows of one table among all rows of another.

Rows with one vector are a class with its k least values; only classes are compared, so however many
rows share a vector, they cost one comparison. Reference classes are dealt to cells around pivots
and cut into blocks by their distance to the pivot. From each cell's k least distances follows a
bound for every query: its k-th neighbour is no further. A query visits its own cell first,
which makes the bound exact or nearly so, and then every other cell that the bound still
reaches, by the blocks' distances and by the plane halfway between two pivots. No neighbour is
lost; how many cells are visited depends on the data.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.written import written

#: Pivots at most, classes in a cell that they aim at, classes of a block and queries of a chunk.
PIVOTS, CELL, BLOCK, CHUNK = 1024, 2048, 2048, 256
_SLACK = 1e-9


def feature_array(features: list[str]):
    """The features as an array of doubles; null where one is missing or not finite."""
    cols = [F.col(c).cast("double") for c in features]
    fine = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)) for c in cols]
    keep = fine[0]
    for f in fine[1:]:
        keep = keep & f
    return F.when(keep, F.array(*[c + F.lit(0.0) for c in cols]))


def _matrix(column) -> np.ndarray:
    if hasattr(column, "chunks"):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed feature by feature, so that equal ones are equal to the last bit."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        d *= d
        out += d
    return out


def classes_of(reference: DataFrame, features: list[str], value: str, k: int) -> DataFrame:
    """x, ys: each different vector with its k least values."""
    rows = reference.select(feature_array(features).alias("x"), F.col(value).cast("double").alias("y")).where("x is not null and y is not null and not isnan(y)")
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("x").orderBy("y"))).where(F.col("nth") <= k)
    return few.groupBy("x").agg(F.sort_array(F.collect_list("y")).alias("ys"))  # at most k values


class Pivots:
    """The pivots and, for each cell, the k least distances of its rows (rows count, not classes) and its greatest."""

    def __init__(self, pivots: np.ndarray, least: list[list[float]], widest: list[float]):
        self.at = pivots
        flat = [(i, d) for i, own in enumerate(least) for d in own]
        self.cell = np.array([i for i, _ in flat], dtype=np.int64)
        self.least = np.array([d for _, d in flat])
        self.widest = np.array(widest)
        self.apart = np.sqrt(squared(pivots, pivots))

    def bound(self, d: np.ndarray, k: int) -> np.ndarray:
        """From the distances to the pivots: what the k-th neighbour is no further than."""
        if len(self.least) < k:
            return np.full(len(d), np.inf)
        return np.partition(d[:, self.cell] + self.least[None, :], k - 1, axis=1)[:, k - 1] * (1 + _SLACK)

    def reached(self, d: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of the cells besides its own that can hold a row within that distance."""
        own = d.argmin(axis=1)
        near = d[np.arange(len(d)), own]
        plane = (d**2 - near[:, None] ** 2) / np.maximum(2 * self.apart[own], 1e-300)
        far = np.maximum(d - self.widest[None, :], plane)
        slip = _SLACK * d * np.maximum(1, d / np.maximum(self.apart[own], 1e-300))
        ok = (far <= within[:, None] * (1 + _SLACK) + slip) & (self.widest >= 0)[None, :]
        ok[np.arange(len(d)), own] = False
        return np.nonzero(ok)


def _cut(rows: DataFrame, size: int, kind: str, parts: int) -> DataFrame:
    """rows (cell, d, x, more) in order of their distance d to the pivot, size of them in one row.

    kind "ys": reference classes; kind "within": queries (id, within).
    """
    schema = "cell int, low double, high double, x binary, d binary, " + ("ys binary, counts binary" if kind == "ys" else "within binary, id binary")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        held, now, n = [], None, 0

        def out(parts_):
            t = pa.Table.from_batches(parts_)
            d = t.column("d").to_numpy()
            first, last = d[0], d[-1]
            if kind == "ys":
                ys = t.column("ys").combine_chunks()
                more = [ys.flatten().to_numpy(zero_copy_only=False).tobytes(), np.diff(ys.offsets.to_numpy()).astype(np.int64).tobytes()]
            else:
                within = t.column("within").to_numpy()
                first, last = float((d - within).min()), float((d + within).max())
                more = [within.tobytes(), t.column("id").to_numpy().tobytes()]
            cols = [pa.array([now], pa.int32()), pa.array([first]), pa.array([last]), *[pa.array([v], pa.binary()) for v in (_matrix(t.column("x")).tobytes(), d.tobytes(), *more)]]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                while a < b:
                    if held and (now != cell[a] or n == size):
                        yield out(held)
                        held, n = [], 0
                    now, take = int(cell[a]), min(b - a, size - n)
                    held.append(batch.slice(a, take))
                    n, a = n + take, a + take
        if held:
            yield out(held)

    order = ["cell", "d", "x"]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _visit(queries: DataFrame, blocks: DataFrame, k: int, parts: int) -> DataFrame:
    """(id, d2, y): for each query (cell, d, x, within, id) and block of its cell the k nearest rows there that are within reach."""
    chunks = _cut(queries, CHUNK, "within", parts).select("cell", F.col("low").alias("from"), F.col("high").alias("to"), F.col("x").alias("q"), "within", "id", F.col("d").alias("qd"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                within, ids, qd, d, ys, counts = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=t) for c, t in (("within", np.float64), ("id", np.int64), ("qd", np.float64), ("d", np.float64), ("ys", np.float64), ("counts", np.int64)))
                x, q = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(n, -1) for c, n in (("x", len(d)), ("q", len(ids))))
                first = np.cumsum(counts) - counts
                found = []
                for a in range(0, len(ids), 64):
                    b = min(a + 64, len(ids))
                    # the classes that some of these queries can reach stand together
                    lo, hi = (qd[a:b] - within[a:b]).min(), (qd[a:b] + within[a:b]).max()
                    slack = _SLACK * (1 + abs(lo) + (abs(hi) if np.isfinite(hi) else 0))
                    s, e = int(np.searchsorted(d, lo - slack)), int(np.searchsorted(d, hi + slack, side="right"))
                    if s == e:
                        continue
                    d2 = squared(q[a:b], x[s:e])
                    ok = d2 <= ((within[a:b] * (1 + 1e-7)) ** 2)[:, None]
                    if e - s > k:  # a class holds a row at least: more than k nearer classes rule one out
                        ok &= d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
                    r, c = np.nonzero(ok)
                    n = counts[s + c]
                    at = np.repeat(first[s + c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    r, dist, y = np.repeat(r, n), np.repeat(d2[r, c], n), ys[at]
                    order = np.lexsort((y, dist, r))
                    r, dist, y = r[order], dist[order], y[order]
                    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                    found.append((ids[a + r[keep]], dist[keep], y[keep]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*found, strict=True)], names=["id", "d2", "y"])

    met = chunks.join(blocks, "cell").where("low <= to + 1e-9 * (1 + abs(to)) and high >= `from` - 1e-9 * (1 + abs(`from`))")
    return met.select("q", "within", "id", "qd", "x", "d", "ys", "counts").mapInArrow(run, "id long, d2 double, y double")


def _best(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("id").orderBy("d2", "y"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def nearest(queries: DataFrame, reference: DataFrame, features: list[str], value: str, k: int) -> DataFrame:
    """(x, near): for each different vector of queries, near holds d2 (squared distance) and y (value) of the k nearest rows.

    Ties at one distance go to the lesser value. Rows of reference with a missing feature or value take
    no part, and a query with a missing feature has no row; with fewer than k rows near is shorter,
    without any it is missing.
    """
    spark = queries.sparkSession
    classes = written(classes_of(reference, features, value, k))
    n = classes.count()
    asked = written(queries.select(feature_array(features).alias("x")).where("x is not null").distinct().withColumn("id", F.monotonically_increasing_id()))
    empty = "x array<double>, near array<struct<d2: double, y: double>>"
    if n == 0:
        return spark.createDataFrame([], empty)
    size = max(1, min(PIVOTS, math.ceil(n / CELL)))
    chosen = classes.orderBy(F.xxhash64("x"), "x").limit(size).select("x").collect()  # at most PIVOTS rows
    pivots = np.array([r.x for r in chosen], dtype=np.float64)
    step = max(1, 2_000_000 // len(pivots))

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, step):
                own = batch.slice(a, step)
                d2 = squared(_matrix(own.column("x")), pivots)
                cell = d2.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.sqrt(d2[np.arange(len(cell)), cell])), own.column("x"), own.column("ys")], names=["cell", "d", "x", "ys"])

    dealt = written(classes.select("x", "ys").mapInArrow(deal, "cell int, d double, x array<double>, ys array<double>"))
    parts = max(4, math.ceil(n / 100_000))
    blocks = written(_cut(dealt, BLOCK, "ys", parts))
    nearby = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).where(F.col("nth") <= k)
    nearby = nearby.groupBy("cell").agg(F.slice(F.sort_array(F.flatten(F.collect_list(F.transform("ys", lambda _: F.col("d"))))), 1, k).alias("least"))
    table = {r.cell: (r.least, r.widest) for r in nearby.join(dealt.groupBy("cell").agg(F.max("d").alias("widest")), "cell").collect()}  # k numbers a pivot
    cells = Pivots(pivots, [table[i][0] if i in table else [] for i in range(len(pivots))], [table[i][1] if i in table else -1.0 for i in range(len(pivots))])
    small = max(1, 4_000_000 // max(len(cells.least), len(pivots), 1))
    visit = "cell int, d double, x array<double>, within double, id long"

    def first(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, small):
                own = batch.slice(a, small)
                d = np.sqrt(squared(_matrix(own.column("x")), pivots))
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell]), own.column("x"), pa.array(cells.bound(d, k)), own.column("id")], names=["cell", "d", "x", "within", "id"])

    def others(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, small):
                own = batch.slice(a, small)
                d = np.sqrt(squared(_matrix(own.column("x")), pivots))
                within = np.minimum(cells.bound(d, k), own.column("kth").to_numpy(zero_copy_only=False))
                q, cell = cells.reached(d, within)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[q, cell]), own.column("x").take(pa.array(q)), pa.array(within[q]), own.column("id").take(pa.array(q))], names=["cell", "d", "x", "within", "id"])

    tasks = max(4, math.ceil(asked.count() / 50_000))
    found = written(_best(_visit(asked.select("x", "id").mapInArrow(first, visit), blocks, k, tasks), k))
    if len(pivots) > 1:
        kth = found.groupBy("id").agg(F.max("d2").alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
        again = asked.join(kth, "id", "left").select("x", "id", F.coalesce(F.sqrt("m"), F.lit(math.inf)).alias("kth"))
        found = written(_best(found.unionAll(_visit(again.mapInArrow(others, visit), blocks, k, tasks)), k))
    near = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d2", "y"))).alias("near"))  # at most k
    return asked.join(near, "id").select("x", "near")


def with_nearest(df: DataFrame, reference: DataFrame, features: list[str], value: str, k: int) -> DataFrame:
    """df with the column near (see nearest); null where a feature is missing."""
    found = nearest(df, reference, features, value, k)
    return df.withColumn("_x", feature_array(features)).join(found.withColumnRenamed("x", "_x"), "_x", "left").drop("_x")


def mean_of(near):
    """The mean of the neighbours' values."""
    return F.aggregate(near, F.lit(0.0), lambda s, e: s + e["y"]) / F.size(near)


def mode_of(near):
    """The value that most neighbours have; of several the least."""
    ys = F.transform(near, lambda e: e["y"])
    counted = F.transform(F.array_distinct(ys), lambda y: F.struct((-F.size(F.filter(ys, lambda z: z == y))).alias("m"), y.alias("y")))
    return F.array_min(counted)["y"]
