"""Best-fit packing with certified bin counts.

Pieces of at most `capacity` tokens are dealt to groups of bounded size, each packed by best-fit
decreasing. Dual feasible functions of a group's sizes give a lower bound of its bins, which stands
beside the result. The pieces of all bins with gaps, whatever their group, form a common pool, which
is dealt to new groups and packed again, as long as that saves bins and there are more of them than
the lower bound of all sizes.

Defined results: a null or empty text is the end id alone; rows alike are packed each on its own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import byte_slices, documents, materialize
from tesserae.llm.tokens import encoder_of

CAPACITY, END_ID = 2048, 0
#: Pieces in a group.
GROUP_PIECES = 8192
#: Texts are encoded in steps of about so many bytes; less than in tokens, as the pipeline's last stage shares its executor's memory.
STEP_BYTES = 1_000_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, bins) of each item."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    open_: dict[int, list[int]] = {}  # bins by the room they have
    rooms = count = 0  # bit r of rooms: some bin has room r
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            own = open_[room]
            b = own.pop()
            if not own:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - room
        room -= s
        if room:
            open_.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins, offsets, count


def lower_bound(n: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of several dual feasible functions: a packing needs at least so many bins. n: items by size, from 0 to capacity."""
    if not n.any():
        return 0
    x = np.arange(capacity + 1)
    # for each threshold t <= capacity / 2: items over capacity - t count as full, items under t as none
    count, weight = np.cumsum(n), np.cumsum(n * x)
    t = np.arange(1, capacity // 2 + 1)
    big = count[-1] - count[capacity - t]
    middle = weight[capacity - t] - weight[t - 1]
    best = int(max(-(-weight[-1] // capacity), (big - (-middle // capacity)).max()))
    # rounding functions: x -> floor((k + 1) x / c) c / k, whole multiples unchanged; values times k
    for k in range(1, 41):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row a piece."""

    def run(batches):
        import pyarrow as pa

        encoder, step = encoder_of(tokenizer, END_ID), 4 * capacity
        for batch in batches:
            own = batch.column("doc_id")
            for a, b, texts in byte_slices(batch.column("text"), STEP_BYTES):
                ids, ends = encoder.encode(texts)
                begins = np.concatenate(([0], ends[:-1]))
                n = -(-(ends - begins) // capacity)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(begins, n) + piece * capacity
                length = np.minimum(np.repeat(ends, n) - at, capacity)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[i : min(i + step, e)]) for i, e in zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True)]
                doc = own.take(pa.array(np.repeat(np.arange(a, b), n)))
                yield pa.RecordBatch.from_arrays([doc, *[pa.array(c, pa.int64()) for c in (piece, piece * capacity, length, crc)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")


def _pack_groups(rows: DataFrame, n: int, number: int, capacity: int) -> DataFrame:
    """rows (row, length) with sequence, at, gap (its bin has room), and its group's bins and lower bound."""
    groups = max(1, -(-n // GROUP_PIECES))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64(F.lit(number), "row"), F.lit(groups)))

    def run(table):
        import pyarrow as pa

        row = table.column("row").to_numpy()
        order = np.argsort(row, kind="stable")
        row, length = row[order], table.column("length").to_numpy()[order]
        g = table.column("g")[0].as_py()
        bins, at, count = best_fit_decreasing(length, capacity)
        bound = lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
        gap = np.bincount(bins, length, minlength=count)[bins] < capacity
        return pa.table({"row": row, "length": length, "sequence": number * 2**52 + g * 2**20 + bins, "at": at, "gap": gap, "bins": np.full(len(row), count), "bound": np.full(len(row), bound)})

    return dealt.select("g", "row", "length").groupBy("g").applyInArrow(run, "row long, length long, sequence long, at long, gap boolean, bins long, bound long")


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(row, sequence, at, bins, bound) for a table of (row, length); row must be unique.

    bins and bound: those of the group in which a piece was packed last.
    """
    sizes = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity rows
    items = np.zeros(capacity + 1, dtype=np.int64)
    items[[r.length for r in sizes]] = [r.n for r in sizes]
    least, full, number = lower_bound(items, capacity), 0, 0
    pool = materialize(_pack_groups(lengths, int(items.sum()), 0, capacity))
    done = None

    def counts(rows):
        return rows.groupBy("gap").agg(F.count_distinct("sequence").alias("bins"), F.count(F.lit(1)).alias("n")).collect()

    have = {r.gap: r for r in counts(pool)}
    while True:
        whole = pool.where("not gap")
        done = whole if done is None else done.unionAll(whole)
        pool = pool.where("gap")
        full += have[False].bins if False in have else 0
        if True not in have or full + have[True].bins <= least:  # no room left over, or as few bins as there can be
            break
        number += 1
        again = materialize(_pack_groups(pool.select("row", "length"), have[True].n, number, capacity))
        got = {r.gap: r for r in counts(again)}
        if sum(r.bins for r in got.values()) >= have[True].bins:
            break
        pool, have = again, got
    return done.unionAll(pool).select("row", "sequence", "at", "bins", "bound")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    cut = materialize(pieces(docs, tokenizer, capacity))
    cut = materialize(cut.withColumn("row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    packed = pack(cut.select("row", "length"), capacity)
    return cut.join(packed, "row").select(
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        "start",
        "length",
        "ids_crc32",
        F.col("sequence").alias("sequence_id"),
        F.col("at").alias("offset"),
        F.col("bins").alias("partition_bins"),
        F.col("bound").alias("partition_bound"),
    )


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer or word_tokenizer())


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, word_tokenizer())
