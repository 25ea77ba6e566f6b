"""Near dedup where many documents share passages, and the hashing of shingles side by side."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import jaccard, simhash


def shingles(t):
    w = t.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    words = np.array([f"w{i}" for i in range(3000)])
    passage = list(rng.choice(words, 80))
    out = []
    for g in range(60):
        base = list(rng.choice(words, 60))
        for changes in (0, 1, 5):  # the last one mostly no near copy of the others
            t = list(base)
            for at in rng.integers(0, len(t), changes):
                t[at] = str(rng.choice(words))
            out.append((len(out), " ".join(t + passage)))
    for cut in (80, 79, 70, 40):  # texts of frequent hashes only
        out.append((len(out), " ".join(passage[:cut])))
    return out


def test_passages_of_many_documents_are_no_meeting_place(spark, rows, monkeypatch):
    """all documents of a passage met at its hashes, and their number squared was compared."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    largest, cross = [], jaccard._cross
    monkeypatch.setattr(jaccard, "_cross", lambda m: largest.append(m.groupBy("key").count().agg(F.max("count")).first()[0] or 0) or cross(m))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.ord: r.root for r in jaccard.near_copies(docs).collect()}
    assert max(largest) <= 8  # 184 of them hold the passage
    assert len({(label[i], got[i]) for i in label}) == len(set(label.values())) == len(set(got.values()))
    assert len(jaccard.frequent_hashes(docs)[0]) >= 76
    assert len(jaccard.frequent_hashes(docs.limit(0))[0]) == 0


def test_any_order_of_frequent_hashes_keeps_near_copies(rows):
    sets = jaccard.shingle_sets([t.encode() for _, t in rows])
    rng = np.random.default_rng(1)
    for share in (0.0, 0.3, 1.0):
        every = np.unique(np.concatenate(sets))
        hashes = np.sort(rng.permutation(every)[: int(share * len(every))])
        slots = np.zeros(1 << jaccard._SLOTS, dtype=bool)
        slots[hashes >> np.uint64(64 - jaccard._SLOTS)] = True
        got = jaccard.prefixes(sets, (hashes, rng.integers(1, 5, len(hashes)).astype(np.int8)), slots)
        assert [len(p) for p in got] == [len(s) // 5 + 1 for s in sets]
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                    assert len(np.intersect1d(got[i], got[j]))


def test_hashes_side_by_side_are_xxh64():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 256, 5000).astype(np.uint8)
    size = np.concatenate([np.arange(80), rng.integers(0, 40, 2000)])
    begin = rng.integers(0, 4900, len(size))
    got = simhash.xxh64(np.concatenate([text, np.zeros(32, dtype=np.uint8)]), begin, size)
    assert got.tolist() == [xxhash.xxh64_intdigest(text[a : a + n].tobytes(), simhash.SEED) for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
