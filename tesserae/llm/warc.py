"""WARC records in seekable Zstandard bundles.

Records are grouped into frames of about FRAME_BYTES, each compressed by itself, and frames into
bundles. A bundle is a whole `.warc.zst` file: its frames, then the seek table of the seekable format
(a skippable frame that any Zstandard reader passes over) with the sizes of all frames. A table row
holds one bundle and, in a column of its own, where each record is: frame and offset inside the frame,
so that `fetch` reads and inflates the one frame it needs. Rows of a table and not files of a local
folder, since executors share nothing but Spark's tables.

Rows with equal payloads make one response record (that of the largest page_id) and revisit records
that refer to it. Payloads are combined before the shuffle by their digests, so a payload travels
once however many rows hold it; revisits are settled on rows of digests alone.

Defined results: a null html is an empty payload; a null url gets a urn of its page; null page_ids come
before all others, and a response or revisit without one has null there; of several rows that could be
the response one is (the greatest url), rows alike in everything are records of their own; payloads
are equal if length, SHA-1 and a 64-bit hash are; html that is not UTF-8 is kept as it is; an empty table gives
an empty table of archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import materialize

#: Bytes of records in a frame and of compressed frames in a bundle, at least (a bundle's last ones can be smaller).
FRAME_BYTES, BUNDLE_BYTES = 1_000_000, 8_000_000
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed values of the seekable format: magic of the skippable frame, magic of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

ENTRY = "record_id string, page_id long, sha string, xx long, copies long, frame int, frame_at long, frame_bytes long, offset long, length long"
ARCHIVE = f"bundle string, data binary, records array<struct<{', '.join(f'{x.split()[0]}: {x.split()[1]}' for x in ENTRY.split(', '))}>>"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f-\xff]")


# ---------------------------------------------------------------- records and bundles


def base32_of(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes, date: str = DATE) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(record_id: str, url: bytes | None, sha1: str, size: int, payload: bytes | None, refers_to: str | None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit: the same HTTP head, which names the full payload's length, and no body."""
    uri = record_id if url is None else _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url).decode()
    fields = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{base32_of(bytes.fromhex(sha1))}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return record("response" if refers_to is None else "revisit", record_id, fields, http if refers_to is not None else http + payload, date)


class Bundle:
    """Takes records, gives a seekable file and the place of each record."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.frame_bytes = frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.open_: list[bytes] = []
        self.held = self.at = 0
        self.places: list[tuple[int, int, int]] = []  # frame, offset in it, length

    def add(self, data: bytes) -> None:
        self.places.append((len(self.frames), self.held, len(data)))
        self.open_.append(data)
        self.held += len(data)
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.open_:
            self.frames.append(self.compressor.compress(b"".join(self.open_)))
            self.sizes.append(self.held)
            self.at += len(self.frames[-1])
            self.open_, self.held = [], 0

    def finish(self) -> bytes:
        self.flush()
        rows = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.sizes, strict=True))
        table = rows + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(begin, compressed size, full size) of each frame, read from the end of a bundle."""
    if len(data) < 17:
        raise ValueError("not a seekable bundle")
    count, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    wide = 12 if flags & 128 else 8
    begin = len(data) - 9 - wide * count
    if magic != SEEKABLE or begin < 8 or struct.unpack_from("<II", data, begin - 8) != (SKIPPABLE, wide * count + 9):
        raise ValueError("not a seekable bundle")
    out, at = [], 0
    for i in range(count):
        packed, full = struct.unpack_from("<II", data, begin + wide * i)
        out.append((at, packed, full))
        at += packed
    return out


def inflate(frame: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(frame)


def parse(data: bytes, at: int = 0, end: int | None = None):
    """(fields, block) of the records that stand one after another in data[at:end]."""
    end = len(data) if end is None else end
    while at < end:
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        begin = head + 4
        after = begin + int(fields["Content-Length"])
        if data[after : after + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record without its end")
        yield fields, memoryview(data)[begin:after]
        at = after + 4


def page_id_of(record_id: str) -> int | None:
    page = record_id.split(":")[2]
    return int(page) if page else None


def page_row(fields: dict, block: memoryview) -> tuple | None:
    """(record_id, page_id, type, refers_to, payload_bytes, payload_digest, payload); None for a record of no page.

    A response's length and digest are those of the bytes it holds, checked against its fields; a revisit
    states them.
    """
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    own = fields["WARC-Record-ID"].strip("<>")
    head = bytes(block[:4096])
    http = head.index(b"\r\n\r\n") + 4
    stated = int(re.search(rb"Content-Length: (\d+)", head[:http])[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "revisit":
        return own, page_id_of(own), kind, page_id_of(fields["WARC-Refers-To"].strip("<>")), stated, digest, None
    payload = block[http:]
    found = base32_of(hashlib.sha1(payload).digest())
    if (len(payload), found) != (stated, digest):
        raise ValueError(f"the payload of {own} is not the one that was written")
    return own, page_id_of(own), kind, None, len(payload), found, payload


# ---------------------------------------------------------------- Spark stages


def rows_of(pages: DataFrame) -> DataFrame:
    """page_id, url, html and what tells payloads apart: sha (hex), xx, n_bytes."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha1(html.cast("binary")).alias("sha"), F.xxhash64(html).alias("xx"), F.octet_length(html).cast("long").alias("n_bytes"), html.alias("html"))


def record_id(page_id: Column, url: Column, sha: Column, number: Column) -> Column:
    """Names a record by page, url, payload and its number among rows alike; the page can be read from it."""
    own = F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("u"), url), F.lit("")), sha, number.cast("string")))
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), own)


def bundles(records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = DATE) -> DataFrame:
    """Archives (see ARCHIVE) of record_id, page_id, url, sha, xx, n_bytes, copies, html and refers_to (null: a response)."""

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
        entry = pa.struct([(x.split()[0], kinds[x.split()[1]]) for x in ENTRY.split(", ")])
        bundle, own = None, []

        def file():
            data = bundle.finish()
            at = [0]
            for f in bundle.frames:
                at.append(at[-1] + len(f))
            places = [(*r, f, at[f], len(bundle.frames[f]), o, n) for r, (f, o, n) in zip(own, bundle.places[1:], strict=True)]
            fields = [pa.array(c, t.type) for c, t in zip(zip(*places, strict=True), entry, strict=True)]
            records_ = pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), pa.StructArray.from_arrays(fields, fields=list(entry)))
            return pa.RecordBatch.from_arrays([pa.array([own[0][0]]), pa.array([data], pa.binary()), records_], names=["bundle", "data", "records"])

        for batch in batches:
            n = batch.num_rows
            names = ("record_id", "page_id", "sha", "xx", "copies", "n_bytes", "refers_to")
            flat = zip(*[batch.column(c).to_pylist() for c in names], strict=True)
            url, html = (batch.column(c).cast(pa.large_binary()) for c in ("url", "html"))
            for i, (rid, page, sha, xx, copies, size, refers) in zip(range(n), flat, strict=True):
                if bundle is None:
                    bundle, own = Bundle(frame_bytes), []
                    bundle.add(record("warcinfo", f"urn:bundle:{rid}", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", date))
                bundle.add(page_record(rid, url[i].as_py(), sha, size, html[i].as_py(), refers, date))
                own.append((rid, page, sha, xx, copies))
                if bundle.at >= bundle_bytes:
                    yield file()
                    bundle = None
        if bundle is not None:
            yield file()

    return records.select("record_id", "page_id", "url", "sha", "xx", "n_bytes", "copies", "html", "refers_to").mapInArrow(run, ARCHIVE)


def write_archives(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = DATE) -> DataFrame:
    """The written table of bundles: a record for each row of pages (page_id, url, html)."""
    rows, none = rows_of(pages), F.lit(None).cast("string")
    one = rows.groupBy("sha", "xx", "n_bytes").agg(F.max(F.struct("page_id", "url")).alias("home"), F.count(F.lit(1)).alias("copies"), F.first("html").alias("html"))
    first = one.select("home.*", "sha", "xx", "n_bytes", "copies", "html", record_id(F.col("home.page_id"), F.col("home.url"), F.col("sha"), F.lit(0)).alias("record_id"), none.alias("refers_to"))
    responses = materialize(bundles(first, frame_bytes, bundle_bytes, date))
    home = responses.select(F.explode("records").alias("r")).where("r.copies > 1").select(F.col("r.sha").alias("sha"), F.col("r.xx").alias("xx"), F.col("r.record_id").alias("refers_to"))
    alike = rows.groupBy("page_id", "url", "sha", "xx", "n_bytes").agg(F.count(F.lit(1)).alias("copies")).join(home, ["sha", "xx"])
    # number 0 of the home's rows is the response itself
    first_number = (record_id(F.col("page_id"), F.col("url"), F.col("sha"), F.lit(0)) == F.col("refers_to")).cast("long")
    later = alike.withColumn("k", F.explode(F.sequence(first_number, F.col("copies")))).where(F.col("k") < F.col("copies"))
    later = later.withColumn("record_id", record_id(F.col("page_id"), F.col("url"), F.col("sha"), F.col("k"))).withColumn("html", none)
    return responses.unionAll(materialize(bundles(later, frame_bytes, bundle_bytes, date)))


READ = "record_id string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _read_batch(rows: list[tuple], payload: bool):
    import pyarrow as pa

    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    held = pa.array([None if p is None or not payload else bytes(p) for p in cols[6]], pa.binary())
    return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols[:6], kinds, strict=True)], held], names=[x.split()[0] for x in READ.split(", ")])


def read_archives(archives: DataFrame, payload: bool = False) -> DataFrame:
    """A row for each record, read frame by frame; the payload itself (null for revisits) only if asked for."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("data")[i].as_py()
                for at, packed, _ in seek_table(data):
                    rows = [page_row(*r) for r in parse(inflate(data[at : at + packed]))]
                    yield _read_batch([r for r in rows if r is not None], payload)

    return archives.select("data").mapInArrow(run, READ)


def fetch(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records named in wanted (record_id), each read from its own frame: the bundle's other frames are not inflated."""

    def run(batches):
        for batch in batches:
            frames = [batch.column(c).to_pylist() for c in ("frame_data", "offset", "length")]
            yield _read_batch([page_row(*next(parse(inflate(f), o, o + n))) for f, o, n in zip(*frames, strict=True)], True)

    places = archives.select("bundle", F.explode("records").alias("r")).select("bundle", "r.record_id", "r.frame_at", "r.frame_bytes", "r.offset", "r.length")
    chosen = materialize(places.join(wanted.select("record_id").distinct(), "record_id"))
    frame = F.substring(F.col("data"), F.col("frame_at").cast("int") + 1, F.col("frame_bytes").cast("int"))
    return archives.select("bundle", "data").join(chosen, "bundle").select(frame.alias("frame_data"), "offset", "length").mapInArrow(run, READ)


def op11_warc_bundles(spark, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
m as (select html, max(page_id) as first from p group by html)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to
from p join m using (html)
"""
