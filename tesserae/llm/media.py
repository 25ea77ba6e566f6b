"""Media columns: bytes kept losslessly as progressive JPEGs, and full-resolution RGB tensors read from them.

encode_media() turns each text into a payload (its UTF-8 bytes and 255s up to a positive multiple of
576) and stores that as the coefficients of a progressive JPEG; read_media() reads any progressive
JPEG column: scans accumulate in coefficient arrays, which are transformed, their chroma is upsampled
and the RGB tensor is kept or summed up. Both work on the rows of a task, a slice at a time; nothing
is shuffled.

Defined results: a null text is empty and has a payload of 576 bytes; equal texts give equal files and
features; a null medium, or one that is no progressive JPEG, gives nulls; an empty table gives an empty result; other columns are carried
or ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import column_bytes, documents, slices

UNIT, TAIL = 576, 32
#: Bytes of payload or file that one step of the codec takes.
STEP_BYTES = 1_000_000


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def encode_media(docs: DataFrame, *more: str) -> DataFrame:
    """n_bytes (of the text), media (the file) and the columns in more."""

    def run(batches):
        import pyarrow as pa

        from tesserae.llm import jpeg

        for batch in batches:
            texts = column_bytes(batch.column("_text"))
            for a, b in slices(texts, STEP_BYTES):
                files = jpeg.encode([payload_of(t) for t in texts[a:b]])
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(files, pa.binary()), *[own.column(c) for c in more]], names=["n_bytes", "media", *more])

    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), *more)
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(run, f"n_bytes long, media binary{fields}")


#: What the decoder raises on bytes that are no whole progressive JPEG.
MALFORMED = (ValueError, IndexError, KeyError, struct.error)


def decodes(file: bytes) -> bool:
    from tesserae.llm import jpeg

    try:
        jpeg.decode_coefficients([file])
    except MALFORMED:
        return False
    return True


READ = "height int, width int, feature string, rgb binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def read_media(media: DataFrame, *more: str, rgb: bool = True) -> DataFrame:
    """What is read from the column media: size, feature (size, sums of the three colours, checksum of
    the tensor), the RGB tensor itself (row by row; null unless rgb), digests of payload (null for a
    file that another encoder wrote) and file."""

    def run(batches):
        import pyarrow as pa

        from tesserae.llm import jpeg

        names = [x.split()[0] for x in READ.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        for batch in batches:
            files = batch.column("media").to_pylist()
            for a, b in slices([f or b"" for f in files], STEP_BYTES):
                readable = [f is not None for f in files[a:b]]
                here = [f for f in files[a:b] if f is not None]
                try:
                    images, v, base = jpeg.decode_coefficients(here) if here else ([], None, None)
                except MALFORMED:  # one file or several: find them, and read the others
                    readable = [f is not None and decodes(f) for f in files[a:b]]
                    here = [f for f, ok in zip(files[a:b], readable, strict=True) if ok]
                    images, v, base = jpeg.decode_coefficients(here) if here else ([], None, None)
                rows = []
                if here:
                    for f, image, payload, tensor in zip(here, images, jpeg.payloads_of(images, v, base), jpeg.tensors(images, v, base), strict=True):
                        flat = tensor.tobytes()
                        r, g, u = tensor.reshape(-1, 3).sum(axis=0).tolist()
                        feature = f"{image.height}x{image.width}:{r},{g},{u}:{zlib.crc32(flat):08x}"
                        own = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]))
                        rows.append((image.height, image.width, feature, flat if rgb else None, *own, len(f), hashlib.sha256(f).hexdigest()))
                got = iter(rows)
                rows = [next(got) if ok else (None,) * len(names) for ok in readable]
                cols = [pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*rows, strict=True), READ.split(", "), strict=True)]
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*cols, *[own.column(c) for c in more]], names=[*names, *more])

    rows = media.select("media", *more)
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "media")
    return rows.mapInArrow(run, READ + fields)


def op1_progressive_jpeg(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = read_media(encode_media(docs, "doc_id"), "doc_id", "n_bytes", rgb=False)
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width")
