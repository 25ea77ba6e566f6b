"""Embedding near-dedup: exact cosine links by dual traversal of cover trees.

1. Rows with equal vectors are one class; only classes are compared.
2. Classes are dealt to cells: a node with too many of them is divided around pivots (spread over a
   sample of the node by farthest-first choice), and so on until every cell is small. A class has its
   home with the nearest pivot and is a guest of another one if it is no further than the threshold
   from the plane halfway between the two: nothing beyond that plane can link with it otherwise.
3. Each cell builds one cover tree of its own classes: nested levels, radii halved from level to level,
   each node with the true radius of what it covers. The trees are a table. The guests that one
   cell sends to another travel as the part of its tree that holds them.
4. A cell's tree is traversed with itself and with each part that came to it: a pair of nodes too
   far apart for their radii is left, one that is near enough for its radii is taken whole, others are
   opened. No link is lost and none is guessed.
5. Degrees are summed, and links join components. Of the links of two trees only a spanning set leaves
   the task.

Distances are those of unit vectors: cosine >= c is distance <= sqrt(2 - 2c). The last decision is
made on the cosine in double precision. Where vectors have no cluster structure the planes and radii
rule nothing out and the work is that of all pairs of cells.

Defined results: a vector that is null, empty, zero or holds a null, NaN or infinity links with
nothing; vectors of different lengths do not link; equal vectors link; a null vec_id is a vector like
any other and names no component unless alone (then null); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import materialize
from tesserae.llm.components import connected_components

COSINE = 0.95
#: Classes in a cell at most, pivots that divide a node at most, sampled classes for each pivot, rows that one task divides.
CELL, FAN, SAMPLE, CHUNK = 8192, 32, 8, 32_768
_SLACK = 1e-6
#: Pivots closer than this do not divide; such nodes are cut by hash.
_LEAST_APART = 1e-3
#: Points under which a node is not divided.
LEAF = 16


def unit_of(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component becomes one first, since squares of very small or large ones would vanish or overflow."""
    x = x.astype(np.float64)
    if x.size:
        x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class CoverTree:
    """Points in an order in which every node is a stretch that begins with its centre.

    Node arrays: begin, end, radius, kids. label and size: what the points stand for.
    """

    def __init__(self, raw: np.ndarray, label: np.ndarray | None = None, size: np.ndarray | None = None):
        """raw: vectors of any length but zero."""
        unit = unit_of(raw)
        self._unit, self._unit32 = unit, unit.astype(np.float32)
        order: list[np.ndarray] = []
        self.begin, self.end, self.radius, self.kids = [], [], [], []
        if len(raw):
            self._build(np.arange(len(raw)), 2.0, order, 0)
        self.order = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        self.begin, self.end, self.radius = np.array(self.begin, dtype=np.int64), np.array(self.end, dtype=np.int64), np.array(self.radius, dtype=np.float64)
        self.label = self.order if label is None else label[self.order]
        self.size = np.ones(len(raw), dtype=np.int64) if size is None else size[self.order]
        self._points(raw[self.order])
        del self._unit, self._unit32

    def _points(self, raw: np.ndarray) -> None:
        self.raw, self.x = raw, unit_of(raw)
        self.x32 = self.x.astype(np.float32)

    def _build(self, members, scale, order, at) -> int:
        """The node of members, whose first one is its centre and covers the rest within scale."""
        me = len(self.begin)
        self.begin.append(at)
        self.end.append(at + len(members))
        self.kids.append(None)
        if len(members) == 1:
            self.radius.append(0.0)
            order.append(members)
            return me
        near = self._unit[members] @ self._unit[members[0]]
        self.radius.append(float(np.sqrt(np.maximum(0, 2 - 2 * near.min())) + 1e-9))
        scale = min(scale, self.radius[me])
        if len(members) <= LEAF or scale < 1e-7:  # few, or so close that no halving tells them apart
            order.append(members)
            return me
        kids = []
        for group in self._cover(members, scale / 2):
            kids.append(self._build(group, scale / 2, order, at))
            at += len(group)
        self.kids[me] = np.array(kids)
        return me

    def _cover(self, members, radius, block: int = 256) -> list[np.ndarray]:
        """Groups around centres that are over radius apart; every member is within radius of its centre."""
        unit, least = self._unit32, 1 - radius * radius / 2
        groups: dict[int, list[np.ndarray]] = {}
        left = members
        while len(left):
            head, left = left[:block], left[block:]
            near = unit[head] @ unit[head].T >= least
            centres, open_ = [], np.ones(len(head), dtype=bool)
            for i in range(len(head)):
                if open_[i]:
                    own = open_ & near[i]
                    own[i] = False
                    groups[int(head[i])] = [head[i : i + 1], head[own]]
                    centres.append(head[i])
                    open_ &= ~own
                    open_[i] = False
            if len(left):
                far = np.ones(len(left), dtype=bool)
                for a in range(0, len(left), 4096):
                    got = unit[left[a : a + 4096]] @ unit[centres].T
                    some = np.flatnonzero(got.max(axis=1) >= least)
                    if not len(some):
                        continue
                    best = got[some].argmax(axis=1)
                    far[a + some] = False
                    by = np.argsort(best, kind="stable")
                    which, first = np.unique(best[by], return_index=True)
                    for c, part in zip(which.tolist(), np.split(left[a + some[by]], first[1:]), strict=True):
                        groups[int(centres[c])].append(part)
                left = left[far]
        return [np.concatenate(g) for g in groups.values()]

    def part(self, labels: np.ndarray) -> CoverTree:
        """The tree of the points with these labels, the centres of their nodes among them."""
        keep = np.isin(self.label, labels)
        before = np.concatenate(([0], np.cumsum(keep)))
        has = before[self.end] > before[self.begin]
        keep[self.begin[has]] = True
        before = np.concatenate(([0], np.cumsum(keep)))
        number = np.cumsum(has) - 1
        out = object.__new__(CoverTree)
        out.begin, out.end, out.radius = before[self.begin[has]], before[self.end[has]], self.radius[has]
        kids = [self.kids[i] for i in np.flatnonzero(has).tolist()]
        out.kids = [None if k is None else number[k[has[k]]] for k in kids]
        out.label, out.size = self.label[keep], self.size[keep]
        out._points(self.raw[keep])
        return out

    def to_bytes(self) -> bytes:
        inner = [k is not None for k in self.kids]
        flat = [k for k in self.kids if k is not None]
        out = io.BytesIO()
        np.savez(out, raw=self.raw, label=self.label, size=self.size, begin=self.begin.astype(np.int32), end=self.end.astype(np.int32), radius=self.radius, inner=np.array(inner, dtype=bool), count=np.array([len(k) for k in flat], dtype=np.int64), kids=(np.concatenate(flat) if flat else np.zeros(0, dtype=np.int64)).astype(np.int32))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> CoverTree:
        got = np.load(io.BytesIO(data))
        out = object.__new__(cls)
        out.begin, out.end, out.radius, out.label, out.size = got["begin"].astype(np.int64), got["end"].astype(np.int64), got["radius"], got["label"], got["size"]
        out.kids = [None] * len(out.begin)
        inner, kids = np.flatnonzero(got["inner"]).tolist(), np.split(got["kids"].astype(np.int64), np.cumsum(got["count"])[:-1])
        for i, k in zip(inner, kids if inner else [], strict=True):
            out.kids[i] = k
        out._points(got["raw"])
        return out


class Links:
    """What a traversal finds: how much each point links to, and a spanning set of links."""

    def __init__(self, sizes: np.ndarray):
        self.degree, self.root = np.zeros(len(sizes) + 1, dtype=np.int64), np.arange(len(sizes))
        self.before = np.concatenate(([0], np.cumsum(sizes)))
        self.sizes = sizes

    def find(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[i]
            if (up == i).all():
                return i
            self.root[i] = self.root[up]
            i = self.root[i]

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.degree, i, self.sizes[j])
        np.add.at(self.degree, j, self.sizes[i])
        self.union(i, j)

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.find(i), self.find(j)
            use = a != b
            i, j, a, b = i[use], j[use], a[use], b[use]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))

    def whole(self, a0: int, a1: int, b0: int, b1: int) -> None:
        """Every point of [a0, a1) with every one of [b0, b1); the same stretch: all its pairs."""
        if (a0, a1) == (b0, b1):
            self.degree[a0:a1] += self.before[a1] - self.before[a0] - self.sizes[a0:a1]
        else:
            self.degree[a0:a1] += self.before[b1] - self.before[b0]
            self.degree[b0:b1] += self.before[a1] - self.before[a0]
        every = np.concatenate((np.arange(a0, a1), np.arange(b0, b1)))
        self.union(np.full(len(every), a0), every)


def by_radius(tree: CoverTree, nodes: np.ndarray, block: int):
    """nodes in blocks whose radii differ by a factor of two at most; single points are blocks of their own."""
    kind = np.where(tree.radius[nodes] > 0, np.frexp(tree.radius[nodes])[1], -2000)
    for k in np.unique(kind).tolist():
        own = nodes[kind == k]
        for a in range(0, len(own), block):
            yield own[a : a + block]


def traverse(s: CoverTree, t: CoverTree, cosine: float, links: Links, shift: int) -> None:
    """All links between the points of s and of t, whose places in links begin at shift; s may be t (shift 0)."""
    reach = np.sqrt(2 - 2 * cosine)
    same = s is t
    stack = [(np.array([0]), np.array([0]))] if len(s.begin) and len(t.begin) else []
    slip = 1e-6 + 2.5e-7 * s.x32.shape[1]  # what single precision can be wrong by
    while stack:
        left, right = stack.pop()
        right = [(b, t.x32[t.begin[b]].T, t.radius[b]) for b in by_radius(t, right, 8192)]
        for a in by_radius(s, left, 1024):
            mine, ra = s.x32[s.begin[a]], s.radius[a]
            for b, yours, rb in right:
                # a bound for the whole block first, then each pair's own, both in single precision
                far = reach + ra.max() + rb.max() + _SLACK
                near = mine @ yours
                p, q = np.nonzero(near >= max(-2.0, 1 - far * far / 2 - slip))
                own = reach + ra[p] + rb[q] + _SLACK
                keep = 2 - 2 * near[p, q] <= own * own + 2 * slip
                if same:
                    keep &= a[p] <= b[q]
                p, q = p[keep], q[keep]
                for x in range(0, len(p), 200_000):
                    _decide(s, t, a[p[x : x + 200_000]], b[q[x : x + 200_000]], cosine, reach, links, shift, same, stack)


def _decide(s, t, na, nb, cosine, reach, links, shift, same, stack) -> None:
    cos = np.einsum("ij,ij->i", s.x[s.begin[na]], t.x[t.begin[nb]])
    dist = np.sqrt(np.maximum(0, 2 - 2 * cos))
    around = s.radius[na] + t.radius[nb]
    keep = dist <= reach + around + _SLACK
    na, nb, cos, dist, around = na[keep], nb[keep], cos[keep], dist[keep], around[keep]
    single = (s.end[na] - s.begin[na] == 1) & (t.end[nb] - t.begin[nb] == 1)
    hit = np.flatnonzero(single & (cos >= cosine) & ~(same & (na == nb)))
    links.pairs(s.begin[na[hit]], t.begin[nb[hit]] + shift)
    for k in np.flatnonzero(~single).tolist():
        u, w = int(na[k]), int(nb[k])
        inside = 2 * s.radius[u] if same and u == w else dist[k] + around[k]
        a0, a1, b0, b1 = int(s.begin[u]), int(s.end[u]), int(t.begin[w]), int(t.end[w])
        if inside <= reach - _SLACK:
            links.whole(a0, a1, b0 + shift, b1 + shift)
            continue
        ku, kw = s.kids[u], t.kids[w]
        if (ku is None and kw is None) or (a1 - a0) * (b1 - b0) <= 4096:
            step = max(1, 4_000_000 // (b1 - b0))
            for a in range(a0, a1, step):
                i, j = np.nonzero(s.x[a : min(a + step, a1)] @ t.x[b0:b1].T >= cosine)
                i, j = i + a, j + b0
                if same and u == w:
                    i, j = i[i < j], j[i < j]
                links.pairs(i, j + shift)
        else:
            stack.append((ku if ku is not None else np.array([u]), kw if kw is not None else np.array([w])))


# ---------------------------------------------------------------- Spark stages


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, h1, h2; classes: cls, h1, h2, v, n, least). h1 is null for a vector that links with nothing."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double") + F.lit(0.0))
    usable = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, v).alias("v"))
    rows = rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")))
    kept = F.first("v")
    if vectors.schema["embedding"].dataType.simpleString() == "array<float>":  # as it came, in half the room
        kept = kept.cast("array<float>")
    own = rows.where("h1 is not null").groupBy("h1", "h2").agg(kept.alias("v"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    own = materialize(own.withColumn("cls", F.monotonically_increasing_id()))
    return rows.select("vec_id", "h1", "h2"), own


def _matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors."""
    if hasattr(column, "chunks"):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def farthest_first(unit: np.ndarray, k: int) -> np.ndarray:
    """Up to k of these unit vectors, each as far from those before it as can be."""
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < k and 2 - 2 * nearest.min() > _LEAST_APART**2:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def children(unit: np.ndarray, home: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, child, at home) of the children that each point goes to."""
    cos = unit @ pivots.T
    best = cos.argmax(axis=1)
    apart = np.sqrt(np.maximum(1e-300, 2 - 2 * pivots @ pivots.T))
    beyond = (cos[np.arange(len(best)), best][:, None] - cos) / apart[best] <= reach + _SLACK
    beyond[np.arange(len(best)), best] = True
    later = np.arange(len(pivots))[None, :] >= best[:, None]  # of two homes the lesser one sends guests
    point, child = np.nonzero(beyond & (later | ~home[:, None]))
    return point, child, home[point] & (child == best[point])


STATE = "cls long, n long, v array<{kind}>, node string, home boolean"


def cells(own: DataFrame, cosine: float, cell: int = CELL) -> DataFrame:
    """cls, n, v, node, home: the cell each class is at home in, and those it is a guest of."""
    reach = float(np.sqrt(2 - 2 * cosine))
    kind = own.schema["v"].dataType.elementType.simpleString()
    state, done, depth = own.select("cls", "n", "v", F.size("v").cast("string").alias("node"), F.lit(True).alias("home")), None, 0

    def pivots_of(table):
        import pyarrow as pa

        order = np.argsort(table.column("cls").to_numpy(), kind="stable")
        got = farthest_first(unit_of(_matrix(table.column("v")))[order], table.column("fan")[0].as_py())
        return pa.table({"node": table.column("node").slice(0, 1), "pivots": pa.array([got.tobytes()], pa.binary()), "k": pa.array([len(got)], pa.int32())})

    def divide(left, right):
        import pyarrow as pa

        cls, home = left.column("cls").to_numpy(), left.column("home").to_numpy(zero_copy_only=False)
        k, fan = right.column("k")[0].as_py() or 0, right.column("fan")[0].as_py()
        if k > 1:
            unit = unit_of(_matrix(left.column("v"))) if len(left) else np.zeros((0, 1))
            point, child, at_home = children(unit, home, np.frombuffer(right.column("pivots")[0].as_py()).reshape(k, -1), reach)
        else:  # all alike: by number, every later part is visited
            own = left.column("part").to_numpy()
            point, child = np.nonzero((np.arange(fan)[None, :] >= own[:, None]) | ~home[:, None])
            at_home = home[point] & (child == own[point])
        got = left.select(["cls", "n", "v", "node"]).take(pa.array(point))
        names = pa.array([f"{n}.{c}" for n, c in zip(got.column("node").to_pylist(), child.tolist(), strict=True)], pa.string())
        return got.set_column(3, "node", names).append_column("home", pa.array(at_home, pa.bool_()))

    while True:
        sizes = state.groupBy("node").agg(F.count_if("home").alias("members"), F.count(F.lit(1)).alias("rows"))
        fan = F.least(F.greatest(F.ceil(F.col("members") * 1.25 / cell), F.lit(2)), F.lit(FAN)).cast("int")
        open_ = materialize(sizes.where(F.col("members") > cell).withColumn("fan", fan).withColumn("chunks", F.ceil(F.col("rows") / CHUNK).cast("int")))
        if open_.isEmpty():
            return state if done is None else done.unionAll(state)
        share = F.col("fan") * SAMPLE / F.col("members") * 2.0**31
        sample = state.where("home").join(open_, "node").where(F.pmod(F.xxhash64("cls", F.lit(depth)), F.lit(2**31)) < share)
        chosen = sample.select("node", "cls", "v", "fan").groupBy("node").applyInArrow(pivots_of, "node string, pivots binary, k int")
        chosen = materialize(open_.join(chosen, "node", "left"))
        left = state.join(open_.select("node", "chunks", "fan"), "node").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
        left = left.withColumn("part", F.pmod(F.xxhash64("cls", F.lit(-1 - depth)), F.col("fan")).cast("int")).drop("chunks", "fan")
        right = chosen.select("node", "fan", "pivots", "k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        moved = left.groupBy("node", "chunk").cogroup(right.groupBy("node", "chunk")).applyInArrow(divide, STATE.format(kind=kind))
        rest = state.join(open_.select("node"), "node", "left_anti").select("cls", "n", "v", "node", "home")
        done = rest if done is None else done.unionAll(rest)
        state, depth = materialize(moved), depth + 1


def plant(homes: DataFrame) -> DataFrame:
    """(node, tree): one row a cell."""

    def run(table):
        import pyarrow as pa

        cls = table.column("cls").to_numpy()
        order = np.argsort(cls, kind="stable")
        tree = CoverTree(_matrix(table.column("v"))[order], cls[order], table.column("n").to_numpy()[order])
        return pa.table({"node": table.column("node").slice(0, 1), "tree": pa.array([tree.to_bytes()], pa.binary())})

    return homes.select("node", "cls", "n", "v").groupBy("node").applyInArrow(run, "node string, tree binary")


def guests_of(asked: DataFrame) -> DataFrame:
    """(node, guest): the parts of trees that go to a cell. asked: node (where to), cls (a list of guests) and their tree."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                part = CoverTree.from_bytes(batch.column("tree")[i].as_py()).part(batch.column("cls")[i].values.to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, 1), pa.array([part.to_bytes()], pa.binary())], names=["node", "guest"])

    return asked.select("node", "cls", "tree").mapInArrow(run, "node string, guest binary")


def link_trees(pairs: DataFrame, cosine: float) -> DataFrame:
    """(cls, links, root) from rows of a tree and a guest, which is null for a tree with itself."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                s = CoverTree.from_bytes(batch.column("tree")[i].as_py())
                if batch.column("guest")[i].is_valid:
                    t = CoverTree.from_bytes(batch.column("guest")[i].as_py())
                    own, links = np.concatenate((s.label, t.label)), Links(np.concatenate((s.size, t.size)))
                    traverse(s, t, cosine, links, len(s.label))
                else:
                    own, links = s.label, Links(s.size)
                    traverse(s, s, cosine, links, 0)
                hit = np.flatnonzero(links.degree[: len(own)])
                root = links.find(np.arange(len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(own[hit]), pa.array(links.degree[hit]), pa.array(own[root[hit]])], names=["cls", "links", "root"])

    return pairs.select("tree", "guest").mapInArrow(run, "cls long, links long, root long")


def link_classes(own: DataFrame, cosine: float, cell: int = CELL) -> DataFrame:
    """(cls, links, root) of all trees with themselves and their guests; one cls can have several rows."""
    dealt = cells(own, cosine, cell)
    homes = dealt.where("home")
    trees = materialize(plant(homes))
    sent = dealt.where("not home").select("cls", F.col("node").alias("to")).join(homes.select("cls", "node"), "cls")
    sent = sent.groupBy("node", "to").agg(F.collect_list("cls").alias("cls"))  # at most the classes of a cell
    guests = guests_of(sent.join(trees, "node").select(F.col("to").alias("node"), "cls", "tree"))
    pairs = guests.join(trees, "node").select("node", "tree", "guest").unionAll(trees.select("node", "tree", F.lit(None).cast("binary")))
    tasks = 4 * max(1, trees.count())
    return materialize(link_trees(pairs.repartition(tasks, F.xxhash64("node", F.coalesce("guest", F.lit(b"")))), cosine))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a vector."""
    rows, own = classes(vectors)
    found = link_classes(own, cosine, cell)
    degree = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("cls").alias("src"), F.col("root").alias("dst")))
    named = own.select("cls", "h1", "h2", "n", "least").join(degree, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    named = materialize(named.select("h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_hash = named.join(ids, "root").select("h1", "h2", "n_links", "component_id")
    got = rows.where("h1 is not null").join(by_hash, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return got.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_cover_tree(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
