"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: 64 majority bits over the XXH64 hashes (seed 42) of a document's 3-word shingles,
repeats included, A-Z lower-cased. Fingerprints link at 2 or fewer differing bits.

Search: each distinct fingerprint goes to the buckets in which a link must show. Of four 16-bit
blocks two differing bits leave two blocks alike, and of the other 32 bits, in three parts, one part
more; so a bucket is a pair of blocks and a part, 42 or 43 bits, and is bounded by the bits that are left
(at most 2**22 fingerprints), not by the rows. Inside a bucket the fingerprints are sorted by Gray rank,
neighbours are put under nodes that hold the bits they all share, nodes are put under further nodes,
and a query adds up the differing bits from the top and leaves a whole group as soon as there are
over 2. Only a spanning set of links leaves a bucket. Most buckets hold a few fingerprints, for
which the index is one node; it is at work in those that very many share.

Defined results: a null text is empty; a document of no words has fingerprint zero and links like
any other; fewer than three words are one shingle; a null doc_id has no say in a component's
number unless it stands alone (then null); rows alike share a fingerprint; an empty table gives an
empty result; other columns are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import column_bytes, documents, keyed, materialize, slices
from tesserae.llm.components import connected_components
from tesserae.llm.jaccard import near_copies

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Children of one node of the index.
FANOUT = 16
_LANES = np.uint64(0x0101010101010101)


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """One 64-bit fingerprint a text."""
    words = [t.lower().split() for t in texts]
    size = np.array([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b" ".join([x for w in words for x in w]) + b" " * 32, dtype=np.uint8)
    long = np.fromiter((len(x) for w in words for x in w), dtype=np.int64, count=int(size.sum()))
    end = np.cumsum(long + 1) - 1
    counts = np.where(size >= shingle, size - shingle + 1, np.minimum(size, 1))
    shift = np.repeat(np.cumsum(size) - size - (np.cumsum(counts) - counts), counts)  # a text's first word against its first shingle
    first = np.arange(counts.sum()) + shift
    last = first + np.repeat(np.minimum(size, shingle), counts) - 1
    begin = end[first] - long[first]
    return majority(xxh64(data, begin, end[last] - begin), counts)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 (seed SEED) of stretches of data, which has 32 bytes more at its end: those of one size below 32 bytes together, longer ones one by one."""
    out = np.empty(len(begin), dtype=np.uint64)
    at_eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    order = np.argsort(np.minimum(size, 32).astype(np.uint8), kind="stable")
    cut = np.searchsorted(np.minimum(size, 32)[order], np.arange(34))
    for n in range(32):
        own = order[cut[n] : cut[n + 1]]
        if not len(own):
            continue
        at = begin[own]
        h = np.full(len(own), np.uint64(SEED + n) + _P5, dtype=np.uint64)
        for i in range(0, n - 7, 8):
            lane = at_eight[at + i].view("<u8").ravel()
            h = _turned(h ^ (_turned(lane * _P2, 31) * _P1), 27) * _P1 + _P4
        done = n & ~7
        if n & 4:
            four = at_eight[at + done].view("<u8").ravel() & np.uint64(0xFFFFFFFF)
            h = _turned(h ^ (four * _P1), 23) * _P2 + _P3
            done += 4
        for i in range(done, n):
            h = _turned(h ^ (data[at + i].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[own] = h ^ (h >> np.uint64(32))
    rest = order[cut[32] :]
    if len(rest):
        whole, digest = data.tobytes(), xxhash.xxh64_intdigest
        out[rest] = np.fromiter((digest(whole[a : a + n], SEED) for a, n in zip(begin[rest].tolist(), size[rest].tolist(), strict=True)), dtype=np.uint64, count=len(rest))
    return out


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits set in over half of each group's hashes; zero for an empty group."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    # eight counters of eight bits share a word, so sums run over at most 255 hashes
    parts = (n + 254) // 255
    group = np.repeat(np.arange(len(n)), parts)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    cut = first[group] + nth * 255
    begin = np.concatenate(([0], np.cumsum(parts)[:-1]))
    fp = np.zeros(len(n), dtype=np.uint64)
    for bit in range(8):
        sums = np.add.reduceat((h >> np.uint64(bit)) & _LANES, cut)
        each = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)  # byte k counts bit 8k + bit
        total = np.add.reduceat(each, begin, axis=0)
        on = (2 * total > n[:, None]).astype(np.uint64)
        fp |= (on << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))[None, :]).sum(axis=1, dtype=np.uint64)
    out[full] = fp
    return out


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """fp (signed) beside the columns in more."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = column_bytes(batch.column("text"))
            fp = [fingerprints_of(texts[a:b]) for a, b in slices(texts)]
            fp = np.concatenate(fp) if fp else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))] + [batch.column(c) for c in more], names=["fp", *more])

    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(run, f"fp long, {fields}" if more else "fp long")


# ---------------------------------------------------------------- the index within a bucket


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order. A node holds mask (bits that all below it share
    and that no node above it holds) and bits (their values); the leaves hold what is left."""

    def __init__(self, fps: np.ndarray, fanout: int = FANOUT):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        common, value, levels = np.full(len(fps), ~np.uint64(0)), self.fps, []
        levels.append((common, value))
        while len(value) > 1:
            cut = np.arange(0, len(value), fanout)
            ones = np.bitwise_and.reduceat(value & common, cut)
            zeros = np.bitwise_and.reduceat(~value & common, cut)
            common, value = ones | zeros, ones
            levels.append((common, value))
        self.levels, self.fanout = levels[::-1], fanout

    def search(self, queries: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, place) pairs within most differing bits, all queries descending together."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), dtype=np.int64)
        spent = np.zeros(len(queries), dtype=np.int64)
        held = np.zeros(1, dtype=np.uint64)  # bits held by the levels above, for each node
        for depth, (common, value) in enumerate(self.levels):
            if depth:
                width = len(common)
                q = np.repeat(q, self.fanout)
                spent = np.repeat(spent, self.fanout)
                node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                ok = node < width
                q, spent, node = q[ok], spent[ok], node[ok]
                held = np.repeat(self.levels[depth - 1][0], self.fanout)[:width]
            own = common & ~held if depth else common
            spent = spent + np.bitwise_count((queries[q] ^ value[node]) & own[node])
            ok = spent <= most
            q, node, spent = q[ok], node[ok], spent[ok]
        yield q, node


def local_roots(fps: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """For distinct fingerprints, the place of the least one that links reach among them."""
    index = GrayIndex(fps)
    n = len(fps)
    block = max(16, 2_000_000 // n)  # queries at a time: bounds what can be found at once
    root = np.arange(n)
    for a in range(0, n, block):
        for q, place in index.search(index.fps[a : a + block], most):
            i, j = q + a, place
            use = i < j
            root = _union(root, i[use], j[use])
    out = np.empty(n, dtype=np.int64)
    out[index.order] = index.order[root]
    return out


def _union(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root after joining i and j: the lesser root wins until nothing changes."""
    while len(i):
        a, b = root[i], root[j]
        use = a != b
        if not use.any():
            break
        i, j, a, b = i[use], j[use], a[use], b[use]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


# ---------------------------------------------------------------- buckets


def _pairs() -> list[tuple[int, int]]:
    return [(a, b) for a in range(4) for b in range(a + 1, 4)]


def _with_mask(masks: list[int]):
    """An array of structs (kind, key): the fingerprint's bits under each mask."""
    return F.array(*[F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(m if m < 2**63 else m - 2**64)).alias("key")) for k, m in enumerate(masks)])


def bucket_masks() -> list[int]:
    """For each pair of blocks, with one third of the other 32 bits as well."""
    out = []
    for x, y in _pairs():
        m = (0xFFFF << 16 * x) | (0xFFFF << 16 * y)
        free = [b for b in range(64) if not m >> b & 1]
        out += [m | sum(1 << b for b in free[a:c]) for a, c in ((0, 11), (11, 22), (22, 32))]
    return out


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Links (src, dst) between distinct fingerprints that span the same components as all pairs within two bits."""
    dealt = fps.select("fp", F.inline(_with_mask(bucket_masks())))
    several = dealt.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "key")
    dealt = materialize(dealt.join(several, ["kind", "key"]).select("kind", "key", "fp"))

    def run(batches):
        import pyarrow as pa

        for kind, key, fp in buckets(batches):
            src, dst = [], []
            cut = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (key[1:] != key[:-1]), [True])))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a > 1:
                    own = fp[a:b]
                    root = local_roots(own.view(np.uint64))
                    moved = np.flatnonzero(root != np.arange(b - a))
                    src.append(own[moved])
                    dst.append(own[root[moved]])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    dealt = dealt.repartition(F.col("kind"), F.col("key")).sortWithinPartitions("kind", "key", "fp")
    return dealt.mapInArrow(run, "src long, dst long")


def buckets(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrow batches of rows sorted by bucket, cut so that no bucket is in two."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "fp")]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        n = len(now[0])
        if not n:
            continue
        last = np.searchsorted(-((now[0] == now[0][-1]) & (now[1] == now[1][-1])).astype(np.int8)[::-1], 0)  # rows of the last bucket
        if last < n:
            yield tuple(x[: n - last] for x in now)
        held = [x[n - last :] for x in now]
    if held is not None:
        yield tuple(held)


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, ord, th, fp, root (a fingerprint of the component) and component_id, one row a document."""
    rows = materialize(fingerprints(keyed(docs), "doc_id", "ord", "th"))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(link_fingerprints(classes.select("fp")))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(ids, "root").select("fp", "root", "component_id"), "fp")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    got = near_components(documents(spark, sf_dir))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least doc_id, of rows alike in it the least text hash.

    The index puts documents together whose fingerprints chains of two differing bits connect; the whole sets
    of five-word shingles decide which of these are near copies (Jaccard similarity of 0.8 or more). Near copies
    that are further apart in bits than the index reaches are found by prefixes (tesserae.llm.jaccard).
    """
    names = docs.columns
    found = near_components(docs).select("ord", "th", F.col("root").alias("near"))
    got = materialize(near_copies(docs, found))
    least = got.groupBy("root").agg(F.min(F.struct("ord", "th")).alias("k")).select("k.ord", "k.th")
    times = got.groupBy("ord", "th").agg(F.count(F.lit(1)).alias("_n"))
    keep = materialize(least.join(times, ["ord", "th"]))
    row = keyed(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in names])), "_row").select("ord", "th", "_row")
    kept = row.join(keep, ["ord", "th"])
    once = kept.where("_n = 1").select("_row.*")
    return once.unionAll(kept.where("_n > 1").dropDuplicates(["ord", "th"]).select("_row.*"))
