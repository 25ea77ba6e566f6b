"""What the operators of this package share: scratch tables, document keys, word and anchor kernels."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled by one NumPy step; a longer document is a step of its own.
SLICE_BYTES = 2_000_000
_LOCAL: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where it is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='tesserae-')}")
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and return a scan of it.

    This cuts the lineage with something that survives lost executors; the job's own shuffle files
    are released as soon as it has ended.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/tesserae-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, ord, th, text and the columns in more; every row keeps its place.

    ord orders the documents (a null doc_id comes last), th is a hash of the text, so (ord, th)
    names a row whatever repeats; rows alike in both are one document to every operator. A null
    text is empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(2**63 - 1)).alias("ord"),
        F.xxhash64(text).alias("th"),
        text.alias("text"),
        *more,
    )


_HELD: dict = {}


def held(key, make):
    """What this Python worker keeps for its further tasks of the same kind. What it kept for another kind goes."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """For tasks that need their memory for themselves: a worker lives through all stages of a pipeline.

    What earlier tasks have freed goes back to the machine, where the C library can do that.
    """
    _HELD.clear()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def scan_partitions(df: DataFrame) -> int:
    """How many tasks read df; grows with the table."""
    return max(1, df.rdd.getNumPartitions())


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about limit bytes each."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def column_bytes(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8, read from its buffers."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def byte_slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of an Arrow string column that hold about limit bytes each, with their values; only one range is copied at a time."""
    import pyarrow.compute as pc

    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    begin = held_bytes = 0
    for i, n in enumerate([*size.tolist(), limit + 1]):
        if i == len(size) or held_bytes and held_bytes + n > limit:
            if i > begin:
                yield begin, i, column_bytes(column.slice(begin, i - begin))
            begin, held_bytes = i, 0
        held_bytes += n


# ---------------------------------------------------------------- hashing of sequences

_R1, _R2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_KEPT_POWERS = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _powers(r: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n; longer ones are made anew, so that a worker keeps little."""
    got = _POWERS.get(r)
    if got is None or len(got[0]) < n:
        out = []
        for base in (r, pow(r, -1, 2**64)):
            p = np.full(max(n, _KEPT_POWERS), base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        got = tuple(out)
        if n <= _KEPT_POWERS:
            _POWERS[r] = got
    return got


class Sequence:
    """Hashes of any stretch of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray, r: int = _R1):
        n = len(values)
        up, self.down = _powers(r, n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def rolling(self, length: int) -> np.ndarray:
        """The hash of every stretch of that length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def word_bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the joined texts, begin and end of each word, and each document's first word (one more at the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    blank = _SPACE[data]
    change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        change = np.concatenate(([0], change))
    begin, end = change[0::2], change[1::2]
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return data, begin, end, np.searchsorted(begin, at)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each word: the sum of a finaliser of its eight-byte parts and their places.

    No polynomial: sums of powers modulo 2**64 agree for any base on long words of two letters in
    Thue-Morse order.
    """
    size = end - begin
    parts = (size + 7) >> 3
    total = int(parts.sum())
    if not total:
        return np.zeros(0, dtype=np.uint64)
    first = np.cumsum(parts) - parts
    place = np.arange(total) - np.repeat(first, parts)
    at = np.repeat(begin, parts) + (place << 3)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, dtype=np.uint8))), 8)[at].view("<u8").ravel()
    left = np.minimum(np.repeat(end, parts) - at, 8)
    eight = eight << ((8 - left) << 3).astype(np.uint64)  # only the word's own bytes
    return mix(np.add.reduceat(mix(eight + mix(place.astype(np.uint64) + np.uint64(_R1))), first) + size.astype(np.uint64) * np.uint64(_R2))


def anchors(values: np.ndarray, first: np.ndarray, window: int, gram: int, among: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Content-defined anchors: in each window of a document, the leftmost of its grams with the least hash.

    values: a hash for each unit (word or byte); first: each document's first unit, one more at the end.
    among: where the grams begin that can be anchors (null: all); windows without any of them are left out.
    Windows with the same content have the same anchor at the same place. One row for each run of
    windows with one anchor: doc, at (of the anchor), lo and hi (first and last window, all as
    places in values), hash (of the gram), fp1 and fp2 (of all units that the run's windows cover).
    """
    n = len(values)
    empty = {k: np.zeros(0, dtype=np.int64) for k in ("doc", "at", "lo", "hi", "hash", "fp1", "fp2")}
    if n < window:
        return empty
    one = Sequence(values, _R1)
    grams = one.rolling(gram)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    if among is not None:
        chosen = np.zeros(len(grams), dtype=bool)
        chosen[among] = True
        least[~chosen] = ~np.uint64(0)
    span, have = window - gram + 1, 1
    while have < span:  # least over spans of doubling length
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    count = np.maximum(np.diff(first) - window + 1, 0)
    keep = np.flatnonzero(count)
    if not len(keep):
        return empty
    sizes = count[keep]
    jump = np.repeat(first[keep] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    places = jump + np.arange(sizes.sum())
    doc = np.repeat(keep, sizes)
    if among is not None:
        led = least[places] != ~np.uint64(0)
        places, doc = places[led], doc[led]
        if not len(places):
            return empty
    at = (least[places] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    lo, hi = places[new], places[last]
    return {
        "doc": doc[new],
        "at": at[new],
        "lo": lo,
        "hi": hi,
        "hash": grams[at[new]].view(np.int64),
        "fp1": one.of(lo, hi + window).view(np.int64),
        "fp2": Sequence(values, _R2).of(lo, hi + window).view(np.int64),
    }

