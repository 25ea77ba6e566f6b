"""Token ids in wavelet matrices, one compressed file of bit-planes a shard.

A shard holds the ids of whole documents in ascending doc_id order. Its ids are renumbered by the
shard's own vocabulary, so it needs only as many planes as that has bits. Each plane is a packed
bit vector with a running count of ones every 512 bits; from these a token can be read anywhere,
counted in any stretch and its occurrences be looked up, without decoding the rest. One more such
vector marks the last id of each document.

The shards are rows of a Parquet table in the shared folder (any store that Spark writes to), so a
lost executor's shards are written again like any task's output.

Defined results: a null or empty text has the end id alone; a null doc_id comes last; rows alike in
doc_id stand next to each other in the order of their texts' hashes; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import byte_slices, documents, keyed, materialize, scan_partitions
from tesserae.llm.tokens import STEP_BYTES, encoder_of

END_ID = 0
#: Tokens at which a shard is closed.
SHARD_TOKENS = 1 << 19
#: Pieces that a worker keeps here, where it has no other stage's memory beside it.
KEPT = 400_000
_MAGIC, _BLOCK = b"TWM2", 512


class BitVector:
    """n bits in packed blocks with the ones before each block, from which rank and select are read."""

    def __init__(self, n: int, blocks: np.ndarray, ones: np.ndarray | None = None):
        self.n, self.blocks = n, blocks.reshape(-1, _BLOCK // 8)
        if ones is None:
            ones = np.zeros(len(self.blocks) + 1, dtype=np.uint32)
            np.cumsum(np.bitwise_count(self.blocks).sum(axis=1, dtype=np.uint32), out=ones[1:])
        self.ones = ones

    @classmethod
    def pack(cls, bits: np.ndarray) -> BitVector:
        blocks = np.zeros(-(-len(bits) // _BLOCK) * (_BLOCK // 8), dtype=np.uint8)
        packed = np.packbits(bits, bitorder="little")
        blocks[: len(packed)] = packed
        return cls(len(bits), blocks)

    def to_bytes(self) -> bytes:
        return self.ones.astype("<u4").tobytes() + self.blocks.tobytes()

    @classmethod
    def from_bytes(cls, n: int, data: bytes, at: int) -> tuple[BitVector, int]:
        """The vector that begins there, and where it ends."""
        count = -(-n // _BLOCK)
        ones = np.frombuffer(data, "<u4", count + 1, at)
        at += 4 * (count + 1)
        size = count * (_BLOCK // 8)
        return cls(n, np.frombuffer(data, np.uint8, size, at), ones), at + size

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.blocks.reshape(-1), bitorder="little", count=self.n).view(bool)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.blocks.reshape(-1)[i >> 3] >> (i & 7).astype(np.uint8) & 1).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place i."""
        if not len(self.blocks):
            return np.zeros(len(i), dtype=np.int64)
        block = i // _BLOCK
        inside = np.unpackbits(self.blocks[np.minimum(block, len(self.blocks) - 1)], axis=1, bitorder="little")
        upto = np.arange(_BLOCK)[None, :] < (i - block * _BLOCK)[:, None]
        return self.ones[block].astype(np.int64) + (inside & upto).sum(axis=1, dtype=np.int64)

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """The places of the k-th bits (from 0) of that value: the block by its count, then inside the block."""
        before = self.ones.astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * _BLOCK - before
        out = np.zeros(len(k), dtype=np.int64)
        for a in range(0, len(k), 8192):
            own = k[a : a + 8192]
            block = np.searchsorted(before, own, side="right") - 1
            inside = np.unpackbits(self.blocks[block], axis=1, bitorder="little") == bit
            seen = np.cumsum(inside, axis=1, dtype=np.int16)
            out[a : a + 8192] = block * _BLOCK + (seen > (own - before[block])[:, None]).argmax(axis=1)
        return out


class WaveletMatrix:
    """Access, rank and select over a sequence of token ids, cut into documents by a bit vector of their last ids."""

    def __init__(self, n: int, vocab: np.ndarray, zeros: np.ndarray, planes: list[BitVector], ends: BitVector):
        self.n, self.vocab, self.zeros, self.planes, self.ends = n, vocab, zeros, planes, ends
        self.bits = len(zeros)

    @classmethod
    def build(cls, ids: np.ndarray, lengths: np.ndarray) -> WaveletMatrix:
        """lengths: ids of each document."""
        vocab = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, dtype=np.int64)
        place = np.zeros(int(vocab[-1]) + 1 if len(vocab) else 1, dtype=np.uint32)
        place[vocab] = np.arange(len(vocab))
        now = place[ids]
        bits = max(1, int(len(vocab) - 1).bit_length()) if len(vocab) else 0
        if bits <= 16:
            now = now.astype(np.uint16)
        zeros, planes = np.zeros(bits, dtype=np.uint64), []
        for level in range(bits):
            one = (now >> (bits - 1 - level) & 1).astype(bool)
            planes.append(BitVector.pack(one))
            low = now[~one]
            zeros[level] = len(low)
            now = np.concatenate((low, now[one]))
        last = np.zeros(len(ids), dtype=bool)
        last[np.cumsum(lengths) - 1] = True
        return cls(len(ids), vocab.astype(np.uint32), zeros, planes, BitVector.pack(last))

    def to_bytes(self) -> bytes:
        """Header, vocabulary, zeros of each plane, planes, document ends."""
        head = _MAGIC + struct.pack("<QII", self.n, self.bits, len(self.vocab))
        return head + self.vocab.astype("<u4").tobytes() + self.zeros.astype("<u8").tobytes() + b"".join(v.to_bytes() for v in [*self.planes, self.ends])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        n, bits, v = struct.unpack_from("<QII", data, 4)
        at = 20
        vocab = np.frombuffer(data, "<u4", v, at)
        at += 4 * v
        zeros = np.frombuffer(data, "<u8", bits, at)
        at += 8 * bits
        vectors = []
        for _ in range(bits + 1):
            one, at = BitVector.from_bytes(n, data, at)
            vectors.append(one)
        return cls(n, vocab, zeros, vectors[:-1], vectors[-1])

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of each document, by selects of their ends."""
        ends = self.ends.select(1, np.arange(int(self.ends.ones[-1]))) + 1
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return starts, ends - starts

    def access(self, i) -> np.ndarray:
        """The ids at places i."""
        i = np.atleast_1d(np.asarray(i, dtype=np.int64)).copy()
        value = np.zeros(len(i), dtype=np.int64)
        for plane, zeros in zip(self.planes, self.zeros.tolist(), strict=True):
            one, before = plane.get(i), plane.rank(i)
            i = np.where(one, zeros + before, i - before)
            value = value << 1 | one
        return self.vocab[value]

    def _descend(self, token: int, begin: int, end: int) -> tuple[int, int, int] | None:
        """The token's number, and its stretch after the last plane."""
        number = int(np.searchsorted(self.vocab, token))
        if number >= len(self.vocab) or self.vocab[number] != token:
            return None
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros.tolist(), strict=True)):
            a, b = plane.rank(np.array([begin, end])).tolist()
            begin, end = (zeros + a, zeros + b) if number >> (self.bits - 1 - level) & 1 else (begin - a, end - b)
        return number, begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often token stands in [begin, end)."""
        got = self._descend(token, begin, self.n if end is None else end)
        return got[2] - got[1] if got else 0

    def occurrences(self, token: int) -> np.ndarray:
        """All places of token, ascending: selects from the last plane up."""
        got = self._descend(token, 0, self.n)
        if got is None:
            return np.zeros(0, dtype=np.int64)
        number, begin, end = got
        i = np.arange(begin, end)
        for level in reversed(range(self.bits)):
            bit = number >> (self.bits - 1 - level) & 1
            i = self.planes[level].select(bit, i - int(self.zeros[level]) if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the last."""
        now = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            one = self.planes[level].bits()
            up = np.empty_like(now)
            z = int(self.zeros[level])
            up[~one] = now[:z]
            up[one] = now[z:] | now.dtype.type(1 << (self.bits - 1 - level))
            now = up
        return self.vocab[now]


def write_shards(docs: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The table of shards: part and seq (their order), n_tokens, doc_ids, file."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part, seq = encoder_of(tokenizer, END_ID, KEPT), TaskContext.get().partitionId(), 0
        ids, own, lengths, size = [], [], [], 0

        def shard():
            matrix = WaveletMatrix.build(np.concatenate(ids), np.concatenate(lengths))
            doc_ids = pa.chunked_array(own).combine_chunks()
            doc_ids = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
            cols = [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([matrix.n], pa.int64()), doc_ids, pa.array([matrix.to_bytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "seq", "n_tokens", "doc_ids", "file"])

        for batch in batches:
            doc_id = batch.column("doc_id")
            for a, b, texts in byte_slices(batch.column("text"), STEP_BYTES):
                got, ends = encoder.encode(texts)
                length, done, base = np.diff(ends, prepend=0), 0, 0
                while done < b - a:  # the documents up to the one that fills the shard
                    upto = min(int(np.searchsorted(ends[done:] - base, shard_tokens - size)) + done + 1, b - a)
                    ids.append(got[base : ends[upto - 1]])
                    own.append(doc_id.slice(a + done, upto - done))
                    lengths.append(length[done:upto])
                    size += len(ids[-1])
                    done, base = upto, int(ends[upto - 1])
                    if size >= shard_tokens:
                        yield shard()
                        ids, own, lengths, size, seq = [], [], [], 0, seq + 1
        if own:
            yield shard()

    ranged = keyed(docs).repartitionByRange(2 * scan_partitions(docs), "ord", "th").sortWithinPartitions("ord", "th")
    shards = ranged.select("doc_id", "text").mapInArrow(run, "part long, seq long, n_tokens long, doc_ids array<long>, file binary")
    return materialize(shards)


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                matrix = WaveletMatrix.from_bytes(batch.column("file")[i].as_py())
                starts, lengths = matrix.documents()
                raw = memoryview(matrix.decode().astype("<u4").tobytes())
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * starts).tolist(), (4 * (starts + lengths)).tolist(), strict=True)]
                n = len(crc)
                cols = [pa.array(np.full(n, batch.column(c)[i].as_py())) for c in ("part", "seq")]
                yield pa.RecordBatch.from_arrays([*cols, batch.column("doc_ids")[i].values, pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = shards.mapInArrow(run, "part long, seq long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # running sums: over one row a range partition, then over one row a shard within its partition
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("part_start"))
    starts = shards.select("part", "seq", "n_tokens").withColumn("shard_start", before(Window.partitionBy("part").orderBy("seq")))
    starts = starts.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("shard_start"))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_wavelet(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return read_shards(write_shards(documents(spark, sf_dir), tokenizer or byte_tokenizer()))
