"""The registered queries and the pipeline against plain Python versions of what they return."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from tesserae.llm import mixing, packing, registry, toxicity, wavelet
from tesserae.llm import simhash as S

rng = np.random.default_rng(11)
WORDS = np.array([f"w{i}" for i in range(400)] + ["Été", "naïve,", "x.\ny", "don't", "<|endoftext|>", "日本語"])


def prose(n):
    return " ".join(rng.choice(WORDS, n))


SHARED = prose(70)
ROWS = [(i, prose(int(rng.integers(3, 90))), "en", f"s{i % 4}") for i in range(60)]
ROWS += [(100, prose(20) + " " + SHARED + " " + prose(20), "en", "s1"), (101, SHARED + " " + prose(9), "en", "s2"), (102, prose(30) + "\t" + SHARED, None, None)]
ROWS += [(110 + i, ROWS[5][1], "en", "s0") for i in range(5)]  # exact copies
ROWS += [(120, ROWS[7][1] + " more", "en", "s0"), (130, None, None, None), (131, "", "en", "s3"), (132, "   \n ", "en", "s3"), (133, "one", "de", "s3"), (134, "ab" * 700, "en", "s1")]
ROWS += [(140, prose(9000), "en", "s2"), (141, "word " * 450_000 + "end", "en", "s2")]  # over 2048 tokens; over one step of the kernels
ROWS += [(150 + i, prose(25) + (" vile scumbag" if i % 3 == 0 else ""), "en", f"s{i % 2}") for i in range(120)]
SOLID = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, lang, source, len(t or ""), 1, "x", 2, 3.0, "s") for i, t, lang, source in ROWS]
    names = "doc_id long, text string, lang string, source string, n_chars long, ord int, th string, size int, score double, _row string"
    spark.createDataFrame(rows, names).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int((i - 150) % 3 == 0)) for i in range(150, 270)] + [(5, None, None), (None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def rows_of(spark, folder, name):
    return [r.asDict() for r in registry.queries()[name](spark, folder).collect()]


def utf8(t):
    return (t or "").encode()


def test_op1_gives_every_byte_back(spark, folder):
    got = {r["doc_id"]: r for r in rows_of(spark, folder, "op1_progressive_jpeg")}
    assert len(got) == len(ROWS)
    for i, t, *_ in ROWS:
        b = utf8(t)
        payload = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len({(got[i]["media_sha256"], got[i]["feature"]) for i in (5, 110, 111)}) == 1 != len({got[i]["media_sha256"] for i in (5, 6)})


def test_op3_removes_what_starts_before(spark, folder):
    words = {i: [w for w in SOLID.findall(utf8(t))] for i, t, *_ in ROWS}
    first: dict = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    got = {r["doc_id"]: r for r in rows_of(spark, folder, "op3_phrases")}
    for i, w in words.items():
        gone = np.zeros(len(w), dtype=bool)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest())


def plain_scores(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    features, weights, bias = toxicity.fit(docs, labels)
    w = dict(zip(features, weights))
    return {i: 1 / (1 + math.exp(-sum((w.get(f, 0.0) for f in toxicity.features_of(utf8(t)).tolist()), bias))) for i, t, *_ in ROWS}


def test_op4_scores_what_the_model_says(spark, folder):
    want = plain_scores(spark, folder)
    for r in rows_of(spark, folder, "op4_toxicity"):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and 150 <= r["doc_id"] < 270:
            assert r["predicted"] == int((r["doc_id"] - 150) % 3 == 0)


def plain_ids(path):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(path)
    return {i: [*t.encode(text or "", add_special_tokens=False).ids, 0] for i, text, *_ in ROWS}


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_op5_stands_in_order(spark, folder):
    ids, start, want = plain_ids(wavelet.byte_tokenizer()), 0, {}
    for i in sorted(ids):
        want[i] = (start, len(ids[i]), crc(ids[i]))
        start += len(ids[i])
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(spark, folder, "op5_wavelet")} == want


def pieces_of(ids):
    return [(a // 2048, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for a in range(0, len(ids), 2048)]


def check_packing(rows):
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    sizes = np.array([r["length"] for r in rows])
    assert len(bins) <= packing.lower_bound(np.bincount(sizes, minlength=2049)) + 1
    assert all(r["partition_bound"] <= r["partition_bins"] for r in rows)


def test_op8_packs_every_piece_once(spark, folder):
    rows = rows_of(spark, folder, "op8_packing")
    want = Counter((i, *p) for i, ids in plain_ids(packing.word_tokenizer()).items() for p in pieces_of(ids))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    check_packing(rows)


def test_packing_pools_the_bins_with_gaps(spark):
    sizes = [700] * 300 + [1400] * 280 + [2048] * 20 + [1] * 30
    table = spark.createDataFrame(list(enumerate(sizes)), "row long, length long")
    before, packing.GROUP_PIECES = packing.GROUP_PIECES, 40
    try:
        got = packing.pack(table).collect()
    finally:
        packing.GROUP_PIECES = before
    fill = Counter()
    for r in got:
        fill[r["sequence"]] += sizes[r["row"]]
    assert len(got) == len(sizes) and max(fill.values()) <= 2048
    assert len(fill) <= packing.lower_bound(np.bincount(sizes, minlength=2049)) + 6


def plain_fingerprint(t):
    w = [x for x in SOLID.findall(utf8(t).lower())]
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_op9_links_within_two_bits(spark, folder):
    fp = {i: plain_fingerprint(t) for i, t, *_ in ROWS}
    ids = sorted(fp)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fp[a] ^ fp[b]).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of(spark, folder, "op9_simhash")}
    assert got == {i: (f"{fp[i]:016x}", label[i]) for i in ids}


def test_fingerprints_far_and_near(spark):
    base = int(rng.integers(0, 2**62))
    chain = [base, base ^ 3, base ^ 3 ^ (5 << 20), base ^ (7 << 40), base ^ (1 << 63) ^ (1 << 31)]
    table = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in chain], "fp long")
    links = {frozenset(x & (2**64 - 1) for x in (r["src"], r["dst"])) for r in S.link_fingerprints(table).collect()}
    near = {frozenset(p) for p in ((chain[0], chain[1]), (chain[1], chain[2]), (chain[0], chain[4]))}
    assert links and links <= near | {frozenset((a, b)) for a in chain for b in chain if a != b and (a ^ b).bit_count() <= 2}
    assert {x for link in links for x in link} == {chain[0], chain[1], chain[2], chain[4]}


# ---------------------------------------------------------------- the pipeline


def plain_lines(rows):
    first, out = {}, []
    for i, t, *rest in sorted(rows, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        gone = [False] * len(lines)
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if window in first:
                gone[k : k + 3] = [True] * 3
            first.setdefault(window, i)
        if not all(gone):
            out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g) if any(gone) else t, *rest))
    return out


def plain_copies(rows):
    sets = {}
    for i, t, *_ in rows:
        w = SOLID.findall(utf8(t).lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    ids, label = sorted(sets), {i: i for i in sets}
    for a in ids:
        for b in ids:
            if a < b and (not sets[a] and not sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return [r for r in rows if label[r[0]] == r[0]]


def test_pipeline_equals_its_plain_version(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    scores = plain_scores(spark, folder)
    rows = plain_copies(plain_lines([r for r in ROWS if scores[r[0]] < 0.3]))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(i, t, s) for i, t, _, s in rows])
    mixed = {r[0]: r for r in con.execute(f"select doc_id, size, taken from ({mixing.OP2_SQL})").fetchall()}
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(packing.word_tokenizer())
    want = Counter()
    for i, text, *_ in rows:
        _, size, taken = mixed[i]
        for p in pieces_of([*t.encode(text or "", add_special_tokens=False).ids, 0]):
            want[(i, *p)] += taken // size if size else 1
    got = [r.asDict() for r in pipeline.run(spark, folder).collect()]
    mine = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    empty = {i for i, (_, size, _) in mixed.items() if not size}
    assert {k: v for k, v in mine.items() if k[0] not in empty} == {k: v for k, v in want.items() if k[0] not in empty and v}
    check_packing(got)


def test_pipeline_on_empty_tables(spark, folder, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("number", range(4))
def test_each_stage_returns_the_columns_of_its_input(spark, folder, number):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 140")
    name, stage = pipeline.STAGES[number]
    got = stage(spark, docs, folder)
    assert got.columns == docs.columns and 0 < got.count() <= 3 * docs.count()
