"""WARC bundles: round trips, revisits, the seek table, single records."""

import base64
import hashlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from tesserae.llm import warc as W

ROWS = [(i, f"http://a.example/{i}", f"<p>{'x y ' * (i % 90)}{i % 40}</p>") for i in range(300)]
ROWS += [(400 + i, "http://b.example/ü \r\n", "same " * 50) for i in range(100)]  # a third alike
ROWS += [(600, None, None), (601, "u", ""), (602, "u", ""), (None, None, "lost"), (None, "v", "lost")]
ROWS += [(610, "u", "twice"), (610, "u", "twice"), (610, "w", "twice"), (700, "long", "é" * 700_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in ROWS], "page_id long, url string, html string, sha string, record_id string")


@pytest.fixture(scope="module")
def archives(pages):
    return W.write_archives(pages, frame_bytes=2000, bundle_bytes=3000)


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_rows_come_back_with_their_records(archives):
    got = Counter(tuple(r) for r in W.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    groups = {}
    for page, url, html in ROWS:
        groups.setdefault((html or "").encode(), []).append((page is not None, page or 0, url or "", page))
    want = Counter()
    for payload, own in groups.items():
        own.sort()
        home = own[-1][3]
        for x in own[:-1]:
            want[x[3], len(payload), digest(payload), "revisit", home] += 1
        want[home, len(payload), digest(payload), "response", None] += 1
    assert got == want


def test_payloads_and_names(archives):
    rows = W.read_archives(archives, payload=True).collect()
    assert len({r.record_id for r in rows}) == len(ROWS)
    assert {bytes(r.payload) for r in rows if r.record_type == "response"} == {(h or "").encode() for _, _, h in ROWS}
    named = {r.record_id for r in rows}
    assert named == {r.record_id for r in archives.select(F.explode("records").alias("r")).select("r.record_id").collect()}


def test_a_bundle_is_a_file_of_independent_frames(archives):
    for r in archives.collect():
        data = bytes(r.data)
        table = W.seek_table(data)
        frames = [zstandard.ZstdDecompressor().decompress(data[a : a + n]) for a, n, _ in table]
        assert [len(f) for f in frames] == [full for _, _, full in table]
        whole = b"".join(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read(-1) for _ in range(1))
        assert whole == b"".join(frames)  # any reader passes over the seek table
        for e in r.records:
            assert frames[e.frame][e.offset : e.offset + e.length].startswith(b"WARC/1.1\r\n") and e.record_id.encode() in frames[e.frame][e.offset : e.offset + 400]
            assert (e.frame_at, e.frame_bytes) == table[e.frame][:2]


def test_fetch_reads_single_records(archives, spark):
    some = W.read_archives(archives, payload=True).where("page_id in (7, 299, 601, 602, 700)").collect()
    got = W.fetch(archives, spark.createDataFrame([(r.record_id,) for r in some] + [("urn:page:5:none",)], "record_id string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in some)


def test_damage_is_seen(archives):
    row = archives.first()
    with pytest.raises(ValueError):
        W.seek_table(bytes(row.data)[:-1])
    record = W.page_record("urn:page:1:x", b"u", "00" * 20, 3, b"abc", None)
    with pytest.raises(ValueError):
        W.page_row(*next(W.parse(record)))


def test_no_rows(spark, pages):
    assert W.read_archives(W.write_archives(pages.limit(0))).count() == 0
