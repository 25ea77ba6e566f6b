"""Substring dedup by blockwise suffix sorting with a difference cover.

A byte is removed if a 100-byte string over it also starts earlier (in a smaller doc_id, or before in
the same document).

1. Every 100-byte string has an anchor, 32 of its bytes chosen by content, so a string that recurs
   has an anchor that recurs; only stretches around anchors found twice go on (see spans).
2. Stretches alike as a whole are settled by their first occurrence. The others are dealt to blocks
   by anchor. Within a block the suffixes that begin a 100-byte string are sorted one bucket of
   first bytes at a time: by their first 31 bytes, and longer ties by the ranks of a difference-cover
   sample, which are computed once for the block. Of neighbours alike in 100 bytes the least stays.
3. An anchor with very many different stretches (a common line in ever new places) would be one
   block; its strings are dealt by their own hashes instead, with minima taken before the shuffle.

Defined results: a null text is empty; a null doc_id comes last; rows with one doc_id and different
texts come in the order of their texts' hashes; rows alike are one document and get one result; a
text of under 100 bytes stays whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import _R1, _R2, Sequence, anchors, column_bytes, documents, keyed, materialize, slices
from tesserae.llm.spans import OCCURRENCE, contexts, covered, gone_by_hash, homes, spans

WINDOW, GRAM = 100, 32
#: Different stretches around one anchor beyond which its strings are dealt by hash.
LARGE = 20_000
#: Bytes of stretches in a block, suffixes in a bucket that is sorted at a time.
BLOCK_BYTES, BUCKET_SUFFIXES = 1_000_000, 200_000
#: Bytes of text in one step of the anchor kernel, which holds some ten 64-bit values for each.
STEP_BYTES = 700_000

# A perfect difference set; every residue modulo 31 is the difference of two of them.
COVER_PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)

_BYTES = np.random.default_rng(7).integers(1, 2**63, 256).astype(np.uint64)  # a value for each byte


def _cover_table() -> np.ndarray:
    """delta[i, j]: the least d for which i + d and j + d are both in the cover."""
    v = COVER_PERIOD
    inside = np.zeros(v, dtype=bool)
    inside[list(COVER)] = True
    d = np.arange(v)
    at = inside[(d[None, :] + d[:, None]) % v]  # [residue, d]
    both = at[:, None, :] & at[None, :, :]
    if not both.any(axis=2).all():
        raise ValueError("not a difference cover")
    return both.argmax(axis=2)


class CoverSort:
    """Sorts suffixes of a text by their first bytes, one bucket at a time."""

    def __init__(self, text: np.ndarray, depth: int = WINDOW):
        v = COVER_PERIOD
        self.depth, self.n = depth, len(text)
        padded = np.concatenate((text, np.zeros(depth + 2 * v + 16, dtype=np.uint8)))
        wide = padded.astype(np.uint64)
        words = wide[: self.n + depth + 2 * v]
        words = words.copy()
        for i in range(1, 8):
            words = (words << np.uint64(8)) | wide[i : i + len(words)]
        self.words = words  # the eight bytes from each place, big-endian
        self.delta = _cover_table()
        self.rank = self._sample_ranks(np.flatnonzero(np.isin(np.arange(self.n) % v, COVER)))

    @staticmethod
    def _split(order: np.ndarray, start: np.ndarray, open_: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Sort the members of the open groups by key; what is left open."""
        perm = np.lexsort((key, start[open_]))
        key, group = key[perm], start[open_]
        order[open_] = order[open_][perm]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1]))))
        sizes = np.diff(np.concatenate((first, [len(key)])))
        start[open_] = np.repeat(open_[first], sizes)
        return open_[np.repeat(sizes > 1, sizes)]

    def _by_prefix(self, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, order, open): at[order] is sorted by depth first bytes; start is where each one's
        group of equals begins in that order, open are the places of groups of more than one."""
        order, start, open_ = np.arange(len(at)), np.zeros(len(at), dtype=np.int64), np.arange(len(at))
        for off in range(0, depth, 8):
            if not len(open_):
                break
            key = self.words[at[order[open_]] + off]
            if depth - off < 8:
                key = key >> np.uint64(8 * (8 - depth + off))
            open_ = self._split(order, start, open_, key)
        return start, order, open_

    def _sample_ranks(self, sample: np.ndarray) -> np.ndarray:
        """The order of the sample's suffixes, whole: by the cover's period first, then by doubling,
        as the place one period (and two, and four) on is in the sample as well."""
        rank = np.zeros(self.n + 1, dtype=np.int64)
        start, order, open_ = self._by_prefix(sample, COVER_PERIOD)
        rank[sample[order]] = start
        step = COVER_PERIOD
        while len(open_):
            on = sample[order[open_]] + step
            key = np.where(on < self.n, rank[np.minimum(on, self.n)], self.n - 1 - on)  # of equals the shorter first
            open_ = self._split(order, start, open_, key)
            rank[sample[order]] = start
            step *= 2
        return rank

    def _less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before suffix j, both alike in as many first bytes as the cover's period."""
        v = COVER_PERIOD
        d = self.delta[i % v, j % v]
        return self.rank[i + d] < self.rank[j + d]

    def sort(self, at: np.ndarray) -> np.ndarray:
        """Places at in the order of their suffixes."""
        group, order, tied = self._by_prefix(at, COVER_PERIOD)
        out = at[order]
        if len(tied):
            out[tied] = self._resolve(out[tied], group[tied])
        return out

    def _resolve(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Sort each tie group (they stand next to each other) by cover ranks: within a residue one
        look-up gives the order; the residues' runs are then merged two by two, all groups at once."""
        v = COVER_PERIOD
        residue = at % v
        rank = self.rank[at + self.delta[residue, residue]]
        perm = np.lexsort((rank, residue, group))
        at, group, residue = at[perm], group[perm], residue[perm]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (residue[1:] != residue[:-1])))
        first = np.flatnonzero(new)
        of = group[first]  # the tie group of each run
        while True:
            nth = np.arange(len(first)) - np.searchsorted(of, of)  # a run's place within its group
            if not nth.any():
                return at
            ends = np.concatenate((first[1:], [len(at)]))
            left = np.flatnonzero((nth % 2 == 0) & np.concatenate((of[1:] == of[:-1], [False])))
            a0, a1, b1 = first[left], ends[left], ends[left + 1]
            na, nb = a1 - a0, b1 - a1
            ia = np.repeat(a0, na) + _ramp(na)
            ib = np.repeat(a1, nb) + _ramp(nb)
            # a's elements go before b's equal ones, so lower bound for a and upper bound for b
            to_a = ia + self._bound(at, at[ia], np.repeat(a1, na), np.repeat(b1, na), False)
            to_b = ib - np.repeat(na, nb) + self._bound(at, at[ib], np.repeat(a0, nb), np.repeat(a1, nb), True)
            merged = at.copy()
            merged[to_a], merged[to_b] = at[ia], at[ib]
            at = merged
            keep = nth % 2 == 0
            first, of = first[keep], of[keep]

    def _bound(self, at, item, lo, hi, upper: bool) -> np.ndarray:
        """How many of at[lo:hi] come before each item (upper: or are equal to it)."""
        begin, lo, hi = lo, lo.copy(), hi.copy()
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo - begin
            mid = (lo[live] + hi[live]) // 2
            right = ~self._less(item[live], at[mid]) if upper else self._less(at[mid], item[live])
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]

    def same_as_before(self, at: np.ndarray) -> np.ndarray:
        """Whether each sorted suffix shares depth bytes with the one before it."""
        same = np.ones(max(0, len(at) - 1), dtype=bool)
        for off in range(0, self.depth, 8):
            live = np.flatnonzero(same)
            a, b = self.words[at[live] + off], self.words[at[live + 1] + off]
            if self.depth - off < 8:
                shift = np.uint64(8 * (8 - self.depth + off))
                a, b = a >> shift, b >> shift
            same[live[a != b]] = False
        return np.concatenate(([False], same)) if len(at) else same


def _ramp(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def later_suffixes(text: np.ndarray, at: np.ndarray, age: np.ndarray, depth: int = WINDOW, bucket: int = BUCKET_SUFFIXES) -> np.ndarray:
    """Which of the suffixes at share their first depth bytes with one of lesser age."""
    sorter = CoverSort(text, depth)
    out = np.zeros(len(at), dtype=bool)
    place = np.full(len(text) + 1, -1, dtype=np.int64)
    place[at] = np.arange(len(at))
    head = (sorter.words[at] >> np.uint64(48)).astype(np.int64)  # the first two bytes
    by_head = np.argsort(head, kind="stable")
    edges = np.concatenate(([0], np.cumsum(np.bincount(head, minlength=1 << 16))))
    low = 0
    while low < 1 << 16:  # buckets of first bytes, as many at a time as fit
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + bucket, side="right")) - 1)
        own = by_head[edges[low] : edges[high]]
        low = high
        if len(own) < 2:
            continue
        order = sorter.sort(at[own])
        first = np.flatnonzero(~sorter.same_as_before(order))
        ages = age[place[order]]
        least = np.repeat(np.minimum.reduceat(ages, first), np.diff(np.concatenate((first, [len(order)]))))
        out[place[order]] = ages > least
    return out


# ---------------------------------------------------------------- Spark stages


def anchor_rows(docs: DataFrame, full: bool) -> DataFrame:
    """The occurrences of all anchors, or only their hashes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = column_bytes(batch.column("text"))
            if full:
                ords, ths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "th"))
            for a, b in slices(texts, STEP_BYTES):
                data = np.frombuffer(b"".join(texts[a:b]), dtype=np.uint8)
                first = np.zeros(b - a + 1, dtype=np.int64)
                np.cumsum([len(t) for t in texts[a:b]], out=first[1:])
                got = anchors(_BYTES[data], first, WINDOW, GRAM)
                if not full:
                    yield pa.RecordBatch.from_arrays([pa.array(got["hash"])], names=["hash"])
                    continue
                doc, base = got["doc"] + a, first[got["doc"]]
                cols = [ords[doc], ths[doc], got["hash"], (got["lo"] - base).astype(np.int32), (got["hi"] - base).astype(np.int32), got["fp1"], got["fp2"]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[x.split()[0] for x in OCCURRENCE.split(", ")])

    return docs.select(*(["ord", "th", "text"] if full else ["text"])).mapInArrow(run, OCCURRENCE if full else "hash long")


def stretches(home_docs: DataFrame) -> DataFrame:
    """(hash, cid, ord, th, lo, n, bytes) of the contexts that share an anchor with another one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, own = column_bytes(batch.column("text")), batch.column("own").to_pylist()
            flat = [(c["hash"], c["cid"], i, c["lo"], c["hi"] - c["lo"] + 1, t[c["lo"] : c["hi"] + WINDOW]) for i, (t, cs) in enumerate(zip(texts, own, strict=True)) for c in cs]
            h, cid, i, lo, n, part = zip(*flat, strict=True)
            ords, ths = (batch.column(c).to_numpy(zero_copy_only=False)[list(i)] for c in ("ord", "th"))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(cid, pa.int64()), pa.array(ords), pa.array(ths), pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(part, pa.binary())], names=["hash", "cid", "ord", "th", "lo", "n", "bytes"])

    return home_docs.mapInArrow(run, "hash long, cid long, ord long, th long, lo int, n int, bytes binary")


def gone_by_sorting(parts: DataFrame) -> DataFrame:
    """(cid, gone): the strings of each stretch that occur earlier in another one, found block by block."""

    def block(rows: list[tuple]):
        import pyarrow as pa

        text = np.frombuffer(b"".join(r[6] for r in rows), dtype=np.uint8)
        n = np.array([r[5] for r in rows])
        base = np.concatenate(([0], np.cumsum([len(r[6]) for r in rows])[:-1]))
        rel = _ramp(n)
        at = np.repeat(base, n) + rel
        # ages: by ord, th and place
        order = np.lexsort((np.repeat([r[4] for r in rows], n) + rel, np.repeat([r[3] for r in rows], n), np.repeat([r[2] for r in rows], n)))
        age = np.empty(len(at), dtype=np.int64)
        age[order] = np.arange(len(at))
        later = np.flatnonzero(later_suffixes(text, at, age))
        if not len(later):
            return None
        which = np.repeat(np.arange(len(rows)), n)[later]
        first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        offsets = pa.array(np.append(first, len(later)), pa.int32())
        cid = np.array([r[1] for r in rows], dtype=np.int64)[which[first]]
        return pa.RecordBatch.from_arrays([pa.array(cid), pa.ListArray.from_arrays(offsets, pa.array(rel[later], pa.int32()))], names=["cid", "gone"])

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("hash", "cid", "ord", "th", "lo", "n", "bytes")], strict=True):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:  # a block holds whole anchors
                    if (out := block(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held and (out := block(held)) is not None:
            yield out

    return parts.repartition("hash").sortWithinPartitions("hash", "cid").mapInArrow(run, "cid long, gone array<int>")


def string_rows(parts: DataFrame) -> DataFrame:
    """(w1, w2, cid, rel, ord, th, lo) of every string of these stretches."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "ord", "th", "lo", "n")}
            pieces = batch.column("bytes").to_pylist()
            for a, b in slices(pieces, STEP_BYTES):
                values = _BYTES[np.frombuffer(b"".join(pieces[a:b]), dtype=np.uint8)]
                n = cols["n"][a:b].astype(np.int64)
                rel = _ramp(n)
                at = np.repeat(np.concatenate(([0], np.cumsum([len(p) for p in pieces[a:b]])[:-1])), n) + rel
                w1, w2 = (Sequence(values, r).of(at, at + WINDOW).view(np.int64) for r in (_R1, _R2))
                of = [np.repeat(cols[c][a:b], n) for c in ("cid", "ord", "th", "lo")]
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(of[0]), pa.array(rel.astype(np.int32)), pa.array(of[1]), pa.array(of[2]), pa.array((of[3] + rel).astype(np.int32))], names=["w1", "w2", "cid", "rel", "ord", "th", "lo"])

    return parts.mapInArrow(run, "w1 long, w2 long, cid long, rel int, ord long, th long, lo int")


def cut_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept from docs with their spans."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text, runs in zip(column_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                begin, end = covered(runs, WINDOW, len(text))
                edges = zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)
                rows.append((len(text), int((end - begin).sum()), len(begin), b"".join([text[x:y] for x, y in edges]) if len(begin) else text))
            n, removed, count, kept = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, removed, count)], pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup_substrings(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: one row a document."""
    rows = keyed(docs)
    twice = anchor_rows(rows, False).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    twice = materialize(twice)
    occurrences = materialize(anchor_rows(rows, True).join(twice, "hash").select(*[x.split()[0] for x in OCCURRENCE.split(", ")]))
    ctx = contexts(occurrences)
    usual = stretches(homes(ctx.where(F.col("around") <= large), rows))
    gone = gone_by_sorting(usual)
    common = ctx.where(F.col("around") > large)
    if not common.isEmpty():
        windows = materialize(string_rows(stretches(homes(common, rows))))
        gone = gone.unionAll(gone_by_hash(windows, ["ord", "th", "lo"]))
    gone = materialize(gone)
    runs = materialize(spans(occurrences, ctx, gone, ["ord", "th", "lo"]))
    return cut_texts(rows.join(runs, ["ord", "th"], "left"))


def op7_suffixes(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
