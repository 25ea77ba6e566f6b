"""Operators on a small table with nulls, ties, repeats, empty and long texts, and clashing names."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import embeddings, line_dedup, media, mixing, packing, phrases, simhash, suffixes, toxicity, wavelet
from tesserae.llm.components import connected_components

rng = np.random.default_rng(1)
WORDS = np.array([f"w{i}" for i in range(300)])
PASSAGE = " ".join(rng.choice(WORDS, 60))


def text(n):
    return " ".join(rng.choice(WORDS, n))


ROWS = [(1, text(80) + " " + PASSAGE, "s1"), (2, PASSAGE + " " + text(30), "s2"), (3, None, None), (4, "", "s1"), (None, text(120), "s1"), (5, "a\nb\nc\nd", "s3"), (6, "x\na\nb\nc", "s3"), (6, "x\na\nb\nc", "s3"), (7, text(3000), "s2"), (8, "ab" * 200, None), (None, None, None)]
SCHEMA = "doc_id long, text string, source string, ord long, th string, hash int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 9, "t", 1) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


RUNS = {
    "media": lambda d: media.read_media(media.encode_media(d, "doc_id"), "doc_id", rgb=False),
    "mixing": lambda d: mixing.mix(d),
    "phrases": lambda d: phrases.dedup_phrases(d),
    "wavelet": lambda d: wavelet.read_shards(wavelet.write_shards(d, wavelet.byte_tokenizer())),
    "lines": lambda d: line_dedup.dedup_lines(d),
    "suffixes": lambda d: suffixes.dedup_substrings(d),
    "simhash": lambda d: simhash.near_components(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_has_a_result_and_empty_tables_work(docs, none, name):
    assert RUNS[name](docs).count() == len(ROWS)
    assert RUNS[name](none).count() == 0


def test_packing_of_odd_rows(docs, none):
    got = packing.pack_documents(docs, packing.word_tokenizer()).toPandas()
    assert (got["piece"] == 0).sum() == len(ROWS)
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert packing.pack_documents(none, packing.word_tokenizer()).count() == 0


def test_phrases_leave_the_first_copy(docs):
    got = {r["doc_id"]: r for r in phrases.dedup_phrases(docs).where("doc_id in (1, 2)").collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 60


@pytest.mark.parametrize("large", [1, 20_000])
def test_suffixes_equal_brute_force(docs, large):
    got = {r["doc_id"]: (r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffixes.dedup_substrings(docs.where("doc_id is not null and doc_id <> 6"), large).collect()}
    seen = set()
    for i, t, _ in sorted((r for r in ROWS if r[0] not in (None, 6)), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert got[i] == (int(gone.sum()), hashlib.sha256(kept).hexdigest())


def test_lines_repeat_rows_alike(docs):
    got = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).where("doc_id in (5, 6)").collect()]
    assert sorted(got) == [(5, "a\nb\nc\nd"), (6, "x"), (6, "x")]


def test_mix_targets_and_caps(docs):
    got = mixing.mix(docs).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all()
    assert abs(got.drop_duplicates("source_size")["target"].sum() - got["size"].sum()) < 1e-6


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == 100


def test_embeddings_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cls string")).collect()}
    assert got[1] == (2, 1) and got[2] == (2, 1) and got[6] == (2, 1) and got[7] == (1, 7) and got[None] == (1, 7)
    assert all(got[i] == (0, i) for i in (3, 4, 5, 8, 9))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("clustered", [True, False])
def test_embeddings_over_many_cells_equal_brute_force(spark, clustered):
    own = np.random.default_rng(3)
    centres = own.normal(size=(12, 6))
    x = (centres[own.integers(0, 12, 900)] + 0.25 * own.normal(size=(900, 6)) if clustered else own.normal(size=(900, 6))).astype(np.float32)
    x[50:90] = x[50] * (1 + np.arange(40))[:, None].astype(np.float32) + own.normal(size=(40, 6)).astype(np.float32) * 1e-5
    x[100] = x[7]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.95
    label = np.arange(900)
    while (new := np.array([label[r].min() for r in near])).tolist() != label.tolist():
        label = new
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(table, cell=30).toPandas().sort_values("vec_id")
    assert got["n_links"].tolist() == (near.sum(axis=1) - 1).tolist()
    assert got["component_id"].tolist() == label.tolist() and got["kept"].tolist() == (label == np.arange(900)).tolist()


def test_toxicity_learns_and_scores_empty_texts(spark):
    docs = spark.createDataFrame([(i, text(30) + (" scumbag" if i % 3 == 0 else "")) for i in range(300)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(250)] + [(1, None), (5000, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels), "doc_id").toPandas().set_index("doc_id")["score"]
    assert all((got[i] >= 0.3) == (i % 3 == 0) for i in range(250, 300)) and 0 <= got[900] == got[901] <= 1
    assert toxicity.fit(docs, labels.where("toxic = 0"))[0] == []


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, text(40) + (" scumbag" if i % 4 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(200)] + [(500, None, None, None, None)]
    rows += [(300 + i, rows[1][1], "en", "s1", 0) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.run(spark, str(tmp_path)).toPandas()
    assert not {i for i in got["doc_id"] if i < 200 and i % 4 == 0}  # toxic ones are gone
    assert not {300, 301, 302} & {*got["doc_id"]}  # copies too
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048


def test_media_that_cannot_be_read_give_nulls(spark):
    from tesserae.llm import jpeg

    good = jpeg.encode([media.payload_of(b"hello")])[0]
    table = spark.createDataFrame([(1, good), (2, b"no jpeg"), (3, None), (4, good[:-40]), (5, b""), (6, good)], "k int, media binary")
    got = {r["k"]: r for r in media.read_media(table, "k").collect()}
    assert got[1]["payload_sha256"] == got[6]["payload_sha256"] and got[1]["rgb"] is not None and len(got[1]["rgb"]) == 3 * got[1]["height"] * got[1]["width"]
    assert all(got[i]["payload_sha256"] is None and got[i]["rgb"] is None for i in (2, 3, 4, 5))


def test_long_words_that_powers_confuse(spark):
    """Words in Thue-Morse order and their complements: alike to sums of powers modulo 2**64, but not to op3."""
    from tesserae.llm.common import word_bounds, word_hashes
    from tesserae.llm.phrases import dedup_phrases

    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words[:30] + [one] + words[30:])), (2, " ".join(words[:30] + [two] + words[30:]))]
    assert [r.n_removed for r in dedup_phrases(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0, 0]
    texts = [f"{one} {two} a aa b\0 b abcdefgh abcdefghi abcdefgh\0".encode()]
    assert len(set(word_hashes(*word_bounds(texts)[:3]).tolist())) == 9


def test_links_of_tiny_and_huge_vectors(spark):
    from tesserae.llm.embeddings import near_duplicates

    rows = [(i, [1.0, 1e-3 * i, 0.5]) for i in range(40)] + [(50, [1e-200, 0.0, 0.0]), (51, [1e200, 1e-200, 5e199]), (52, [1e-310, 0.0, 5e-311])]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = [np.array(v) / np.abs(v).max() for _, v in rows]
    unit = np.array([u / np.linalg.norm(u) for u in unit])
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert [got[i].n_links for i, _ in rows] == links.tolist()
    assert {got[i].component_id for i, _ in rows if i != 50} == {0} and got[50].component_id == 50


def test_files_of_other_encoders_and_text_that_is_not_utf8(spark):
    from pyspark.sql import functions as F

    from tesserae.llm import media, packing, tokens

    made = media.encode_media(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), "doc_id").first().media
    at = made.index(b"\xff\xfe")
    foreign = bytes(made[:at]) + bytes(made[at + 2 + int.from_bytes(made[at + 2 : at + 4], "big") :])
    got = media.read_media(spark.createDataFrame([(bytearray(foreign),)], "media binary")).first()
    assert got.height and got.rgb and got.payload_bytes is None and got.payload_sha256 is None
    raw = spark.createDataFrame([(1, bytearray(b"ab \xff\xfe cd \xe2\x82 ef \xc3 31")), (2, bytearray(b"plain"))], "doc_id long, text binary")
    docs = raw.select("doc_id", F.expr("cast(text as string)").alias("text"))
    encoder = tokens.PieceEncoder(packing.word_tokenizer(), 0)
    rows = {r.doc_id: r.length for r in packing.pack_documents(docs, packing.word_tokenizer()).collect()}
    for i, b in ((1, b"ab \xff\xfe cd \xe2\x82 ef \xc3 31"), (2, b"plain")):
        assert rows[i] == len(encoder.tokenizer.encode(b.decode(errors="replace"), add_special_tokens=False).ids) + 1


def test_phrases_of_passages_cut_at_many_places(spark):
    """A shard can hold phrases that are anchors in its own documents only; windows must be led alike in all shards."""
    import random

    from tesserae.llm.phrases import dedup_phrases

    rng = random.Random(5)
    sources = [[f"w{rng.randrange(5000)}" for _ in range(400)] for _ in range(40)]
    rows = []
    for i in range(600):
        words = []
        for _ in range(rng.randrange(1, 4)):
            a = rng.randrange(360)
            words += rng.choice(sources)[a : a + rng.randrange(45, 140)] + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(10))]
        rows.append((i, words))
    first, want = {}, {}
    for i, w in rows:
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in rows:
        gone = {x for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for x in range(k, k + 50)}
        want[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(8)
    assert {r["doc_id"]: r["kept"].decode() for r in dedup_phrases(docs).collect()} == want


def test_packing_encodes_in_small_steps():
    """What one step of the encoder holds beside the pieces it keeps; six workers share an executor."""
    import random
    import tracemalloc

    import pyarrow as pa

    from tesserae.llm import tokens
    from tesserae.llm.common import byte_slices

    tokenizers = pytest.importorskip("public_tokenizers")
    rng = random.Random(2)
    column = pa.array([" ".join(f"word{rng.randrange(300)}" for _ in range(400)) for _ in range(1000)])
    encoder = tokens.PieceEncoder(tokenizers.path("word_bpe_49k.json"), 0)
    tracemalloc.start()
    for _, _, texts in byte_slices(column, packing.STEP_BYTES):
        encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
