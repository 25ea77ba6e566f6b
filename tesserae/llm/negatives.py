"""Hard negatives by lists shared among clustered anchors.

1. Anchors are clustered around pivots. The members of a cluster lie within an angle of its
   centre, so no member's product with a row can exceed its own norm times
   |row| * cos(max(0, angle(row, centre) - that angle)), the row's bound.
2. All rows are sorted by that bound once for each cluster: the cluster's list, in blocks. The
   number of clusters is fixed, so the lists are that many copies of the table.
3. Every member walks its cluster's list, in chunks of members and blocks of rows, from the greatest bound
   on. It stops at the first row whose bound proves that neither this row nor any later one can
   enter its answer. Rounds take ever more blocks; between rounds the answers of all blocks are
   merged, so that a later block is read only for members that are not certified by then.
4. The first walk finds each anchor's positives. Their scores set the bands of the second walk,
   which finds the negatives.

Products are integers: of floor(scale * x), which is exact in double precision up to 2**53 and
computed in 64-bit integers beyond. Where vectors have no cluster structure the bounds certify
little and a walk reads its whole list: anchors times rows, as blocks of a matrix product.

Defined results: a row with a null vec_id, label or vector, an empty vector or a null, NaN or infinite
component takes no part; of rows with one vec_id the one with the greatest label and vector does;
components beyond 2**25 after scaling count as that bound; vectors of different lengths never
meet; a zero vector scores 0 against all; an anchor without other rows of its label, or a positive
without negatives in its band, has no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import materialize

SCALE, BOUND = 256, 2**25
POSITIVES, NEGATIVES = 5, 3
#: The band of negatives, in percent of the positive's score.
LOW, HIGH = 50, 95
CLUSTERS, CHUNK, STEP = 8, 256, 512
#: Components in a block of rows at most.
BLOCK_VALUES = 262_144
#: Anchors that place the clusters at most; all anchors are then dealt to the nearest.
SAMPLE = 2000
#: Share of each list that has been walked after each round.
ROUNDS = (0.05, 0.25, 1.0)
_SLACK = 1e-6


def relabelled(vec_id: Column, label: Column) -> Column:
    """The noise that the query plants: every seventh row has the next label."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, d, v (integers): a row for each vec_id."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(fine)
    held = F.transform("x", lambda c: F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), F.floor(F.least(F.greatest(c * scale, F.lit(-1e15)), F.lit(1e15))).cast("double"))).cast("int"))
    one = rows.select("vec_id", "label", held.alias("v")).groupBy("vec_id").agg(F.max(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", "r.label", F.size("r.v").alias("d"), "r.v")


def _matrix(column) -> np.ndarray:
    if hasattr(column, "chunks"):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _norms(v: np.ndarray) -> np.ndarray:
    x = v.astype(np.float64)
    return np.sqrt((x * x).sum(axis=1))


def _angles(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles of rows to unit centres; 0 for a zero row."""
    n = _norms(v)
    unit = v / np.where(n > 0, n, 1)[:, None]
    return np.where(n[:, None] > 0, np.arccos(np.clip(unit @ centres.T, -1, 1)), 0.0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b, exact: in doubles where every sum fits, else in 64-bit integers."""
    top = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


# ---------------------------------------------------------------- clusters and lists


def centres_of(anchors: DataFrame, clusters: int = CLUSTERS) -> list[tuple[int, int, np.ndarray]]:
    """(d, number, unit vector) of the clusters for each length of vectors, fitted on at most SAMPLE anchors of a length."""
    few = anchors.withColumn("nth", F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64("vec_id"), "vec_id"))).where(F.col("nth") <= SAMPLE)
    rows: dict[int, list] = {}
    for r in few.select("d", "nth", "v").collect():  # at most SAMPLE rows for each length
        rows.setdefault(r.d, []).append((r.nth, r.v))
    out = []
    for d, own in sorted(rows.items()):
        x = np.array([v for _, v in sorted(own, key=lambda r: r[0])], dtype=np.float64)
        n = _norms(x)
        x = x[n > 0] / n[n > 0][:, None]
        if not len(x):
            out.append((d, 0, np.eye(1, d)[0]))
            continue
        chosen = [0]
        nearest = x @ x[0]
        while len(chosen) < min(clusters, len(x)):
            chosen.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, x @ x[chosen[-1]])
        c = x[chosen]
        for _ in range(10):  # spherical k-means on the sample
            home = (x @ c.T).argmax(axis=1)
            sums = np.array([x[home == k].sum(axis=0) if (home == k).any() else c[k] for k in range(len(c))])
            size = _norms(sums)
            c = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], c)
        out += [(d, k, v) for k, v in enumerate(c)]
    return out


def _by_length(centres) -> dict[int, np.ndarray]:
    return {d: np.array([v for e, _, v in centres if e == d]) for d in {d for d, _, _ in centres}}


def dealt(anchors: DataFrame, centres, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(members: d, cluster, chunk, vec_id, label, v, norm; spread: d, cluster, angle) of all anchors."""
    by = _by_length(centres)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ds = batch.column("d").to_numpy()
            for d in np.unique(ds).tolist():
                own = batch.filter(pa.array(ds == d))
                v = _matrix(own.column("v"))
                angle = _angles(v, by[d])
                home = angle.argmin(axis=1)
                cols = [pa.array(home.astype(np.int32)), pa.array(angle[np.arange(len(v)), home]), pa.array(_norms(v))]
                yield pa.RecordBatch.from_arrays([*cols, *[own.column(c) for c in ("d", "vec_id", "label", "v")]], names=["cluster", "angle", "norm", "d", "vec_id", "label", "v"])

    members = materialize(anchors.select("d", "vec_id", "label", "v").mapInArrow(run, "cluster int, angle double, norm double, d int, vec_id long, label long, v array<int>"))
    spread = members.groupBy("d", "cluster").agg(F.max("angle").alias("angle"), F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
    spread = materialize(spread)  # a row for each cluster
    members = members.join(F.broadcast(spread.select("d", "cluster", "chunks")), ["d", "cluster"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    return members.drop("angle", "chunks"), spread


LIST = "d int, cluster int, top double, n int, ids binary, labels binary, bounds binary, vectors binary"


def lists(rows: DataFrame, centres, spread: list, values: int = BLOCK_VALUES) -> DataFrame:
    """The clusters' lists: blocks of rows in order of their bounds; top is a block's greatest bound."""
    by = _by_length(centres)
    wide = {(r.d, r.cluster): r.angle for r in spread}

    def bounds(batches):
        import pyarrow as pa

        for batch in batches:
            ds = batch.column("d").to_numpy()
            for d in np.unique(ds).tolist():
                if d not in by:
                    continue
                own = batch.filter(pa.array(ds == d))
                v = _matrix(own.column("v"))
                angle, norm = _angles(v, by[d]), _norms(v)
                for k in range(len(by[d])):
                    if (d, k) in wide:
                        bound = norm * np.cos(np.maximum(0, angle[:, k] - wide[d, k] - _SLACK))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, dtype=np.int32)), pa.array(-bound), *[own.column(c) for c in ("d", "vec_id", "label", "v")]], names=["cluster", "down", "d", "vec_id", "label", "v"])

    def pack(batches):
        import pyarrow as pa

        held, size = [], 0

        def cut(parts):
            table = pa.Table.from_batches(parts)
            first = table.slice(0, 1)
            v = _matrix(table.column("v"))
            kind = np.int16 if np.abs(v).max(initial=0) < 2**15 else np.int32
            data = [table.column("vec_id").to_numpy().tobytes(), table.column("label").to_numpy().tobytes(), (-table.column("down").to_numpy()).tobytes(), v.astype(kind).tobytes()]
            cols = [first.column("d").combine_chunks(), first.column("cluster").combine_chunks(), pa.array([-first.column("down")[0].as_py()]), pa.array([len(v)], pa.int32()), *[pa.array([x], pa.binary()) for x in data]]
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in LIST.split(", ")])

        now, block = None, 0
        for batch in batches:
            key = batch.column("d").to_numpy().astype(np.int64) << 32 | batch.column("cluster").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                while a < b:
                    if held and (now != key[a] or size == block):
                        yield cut(held)
                        held, size = [], 0
                    now, block = key[a], max(1, values // max(1, int(key[a] >> 32)))
                    take = min(b - a, block - size)
                    held.append(batch.slice(a, take))
                    size, a = size + take, a + take
        if held:
            yield cut(held)

    sent = rows.select("d", "vec_id", "label", "v").mapInArrow(bounds, "cluster int, down double, d int, vec_id long, label long, v array<int>")
    order = ["d", "cluster", "down", "vec_id"]  # vec_id, so that rows with one bound can be cut apart
    parts = max(8, 2 * rows.rdd.getNumPartitions())
    return materialize(sent.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, LIST))


def rounds_of(blocks: DataFrame) -> DataFrame:
    """blocks with the round in which they are walked: by their bounds' place in the list, the same for equal bounds."""
    shares = F.array(*[F.lit(1 - s) for s in ROUNDS[:-1]])
    edges = blocks.groupBy("d", "cluster").agg(F.percentile_approx("top", shares, 10_000).alias("edges"))
    nth = F.aggregate("edges", F.lit(0), lambda acc, e: acc + (F.col("top") < e).cast("int"))
    return blocks.join(F.broadcast(edges), ["d", "cluster"]).withColumn("round", nth).drop("edges")  # a row for each cluster


# ---------------------------------------------------------------- walks


def walk(m, same: bool, k: int, ids, labels, bounds, v) -> tuple | None:
    """(vec_id, band, other, score): what one block has for the members m, at most k rows for each band.

    m: Arrow structs of vec_id, label, v, norm and bands (band, low, high): only scores of low to high count.
    Rows come by falling bounds; a member stops when its bound is below all its lows, which rise as it
    finds k rows.
    """
    own, label, norm = (m.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "norm"))
    a = _matrix(m.field("v"))
    bands = m.field("bands")
    at = bands.offsets.to_numpy()
    at = at - at[0]
    flat = bands.flatten()
    band, low, high = (flat.field(c).to_numpy(zero_copy_only=False).copy() for c in ("band", "low", "high"))
    of = np.repeat(np.arange(len(own)), np.diff(at))  # the member of each band
    key, other, score = (np.zeros(0, dtype=np.int64) for _ in range(3))
    for x in range(0, len(ids), STEP):
        need = np.full(len(own), np.inf)
        np.minimum.at(need, of, low.astype(np.float64))
        reach = norm * bounds[x]
        go = np.flatnonzero(reach + np.abs(reach) * 1e-9 + 1 >= need)
        if not len(go):
            break
        s = products(a[go], v[x : x + STEP])
        fits = ((labels[None, x : x + STEP] == label[go][:, None]) == same) & (ids[None, x : x + STEP] != own[go][:, None])
        place = np.full(len(own), -1)
        place[go] = np.arange(len(go))
        new = [(key, other, score)]
        for b in np.flatnonzero(place[of] >= 0).tolist():
            row = place[of[b]]
            c = np.flatnonzero(fits[row] & (s[row] >= low[b]) & (s[row] <= high[b]))
            if len(c):
                new.append((np.full(len(c), b), ids[x + c], s[row, c]))
        if len(new) == 1:
            continue
        key, other, score = (np.concatenate(c) for c in zip(*new, strict=True))
        order = np.lexsort((other, -score, key))
        key, other, score = key[order], other[order], score[order]
        nth = np.arange(len(key)) - np.searchsorted(key, key)
        full = nth == k - 1
        low[key[full]] = np.maximum(low[key[full]], score[full])
        keep = nth < k
        key, other, score = key[keep], other[keep], score[keep]
    return (own[of[key]], band[key], other, score) if len(key) else None


FOUND = "vec_id long, band long, other long, score long"


def walk_round(asked: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """FOUND of all members in these blocks of their clusters' lists."""
    chunks = asked.groupBy("d", "cluster", "chunk").agg(F.collect_list(F.struct("vec_id", "label", "v", "norm", "bands")).alias("m"))  # few members, by the way they were dealt
    # each chunk goes to all slots of its list, each block to one: some sqrt(blocks) keys a cluster
    slots = blocks.groupBy("d", "cluster").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("int").alias("slots"))
    slots = F.broadcast(slots)  # a row for each cluster
    left = chunks.join(slots, ["d", "cluster"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    right = blocks.join(slots, ["d", "cluster"]).withColumn("slot", F.pmod(F.xxhash64("ids"), F.col("slots")).cast("int")).drop("slots")

    def open_(x):
        reach = F.col("top") * x["norm"]
        return reach + F.abs(reach) * 1e-9 + 1 >= F.array_min(F.transform(x["bands"], lambda b: b["low"]))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                d = batch.column("d")[i].as_py()
                ids, labels, bounds = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=t) for c, t in (("ids", np.int64), ("labels", np.int64), ("bounds", np.float64)))
                raw = batch.column("vectors")[i].as_buffer()
                v = np.frombuffer(raw, dtype=np.int16 if raw.size == 2 * d * len(ids) else np.int32).reshape(-1, d)
                found = walk(batch.column("m")[i].values, same, k, ids, labels, bounds, v)
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=[x.split()[0] for x in FOUND.split(", ")])

    pairs = left.join(right, ["d", "cluster", "slot"]).where(F.exists("m", open_))
    return pairs.select("d", "m", "ids", "labels", "bounds", "vectors").mapInArrow(run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """FOUND and rank (from 1) of the first k rows of each band."""
    nth = F.row_number().over(Window.partitionBy("vec_id", "band").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def walk_lists(asked: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """The first k rows of each band of each member, whose label is the member's (same) or another one."""
    found = None
    for r in range(len(ROUNDS)):
        got = walk_round(asked, blocks.where(F.col("round") == r), same, k)
        found = materialize(best(got if found is None else got.unionAll(found.drop("rank")), k))
        if r + 1 < len(ROUNDS):
            kth = found.where(F.col("rank") == k).groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("kth"))
            low = lambda b: F.greatest(b["low"], F.coalesce(F.col("kth")[b["band"]], b["low"]))
            raised = F.transform("bands", lambda b: F.struct(b["band"].alias("band"), low(b).alias("low"), b["high"].alias("high")))
            asked = materialize(asked.join(kth, "vec_id", "left").withColumn("bands", raised).drop("kth"))
    return found


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding; anchor: which rows are anchors, a condition on vec_id and label. Negatives
    score from low to high percent of the positive's score.
    """
    rows = materialize(usable(vectors, scale))
    anchors = rows.where(anchor)
    centres = centres_of(anchors)
    members, spread = dealt(anchors, centres)
    blocks = rounds_of(lists(rows, centres, spread.collect()))  # spread: a row for each cluster
    far = 2**62
    everything = F.array(F.struct(F.lit(0).cast("long").alias("band"), F.lit(-far).cast("long").alias("low"), F.lit(far).cast("long").alias("high")))
    asked = materialize(members.withColumn("bands", everything))
    near = walk_lists(asked, blocks, True, positives).select("vec_id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    band = F.struct(F.col("positive_id").alias("band"), F.expr(f"({low} * positive_score + 99) div 100").alias("low"), F.expr(f"({high} * positive_score) div 100").alias("high"))
    bands = near.where(F.col("positive_score") >= 0).groupBy("vec_id").agg(F.collect_list(band).alias("bands"))  # at most positives rows
    found = walk_lists(materialize(asked.drop("bands").join(bands, "vec_id")), blocks, False, negatives)
    pairs = found.select("vec_id", F.col("band").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(near, ["vec_id", "positive_id"]).select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.select("vec_id", relabelled(F.col("vec_id"), F.col("label")).alias("label"), "embedding")
    return mine(rows, F.col("vec_id") % 50 == 0)


OP13_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by score desc, id))::int as rank, id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""
