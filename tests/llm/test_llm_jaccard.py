"""The pipeline's near-dedup stage against brute force on planted near copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import jaccard, simhash
from tesserae.llm.common import keyed


def shingles(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def survivors(rows):
    """doc_ids of the least document of each component, all pairs compared."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    words = np.array([f"W{i}" for i in range(400)])
    common, out = list(rng.choice(words, 12)), []
    for g in range(25):
        base = list(rng.choice(words, int(rng.integers(1, 260))))
        for changes in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            t = list(base)
            for at in rng.integers(0, len(t), changes):
                t[at] = str(rng.choice(words))
            out.append((len(out), " ".join(t + common * (g % 2))))
    base = list(rng.choice(words, 150))
    for _ in range(60):  # a large group whose members are near the first, not all near each other
        t = list(base)
        for at in rng.integers(0, len(t), 3):
            t[at] = str(rng.choice(words))
        out.append((len(out), " ".join(t)))
    return [*out, (9000, ""), (9001, None), (9002, "a b"), (9003, "A  b"), (9004, "a b c")]


def test_stage_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(r["doc_id"] for r in simhash.simhash_stage(spark, docs, "").collect())
    assert got == sorted(survivors(rows))
    assert simhash.simhash_stage(spark, docs.limit(0), "").count() == 0


def test_stage_goes_through_the_index(spark, rows, monkeypatch):
    calls, links = [], simhash.link_fingerprints
    monkeypatch.setattr(simhash, "link_fingerprints", lambda fps: calls.append(1) or links(fps))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(r["doc_id"] for r in simhash.simhash_stage(spark, docs, "").collect())
    assert calls and got == sorted(survivors(rows))


def test_what_an_index_puts_together_is_confirmed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = keyed(docs).select("ord", "th", F.lit(1).alias("near"))
    sketches = jaccard._sketches(docs).cache()
    assert jaccard._proposed(sketches, found).distinct().count() >= sketches.select("id").distinct().count() - 1
    assert jaccard.near_copies(docs, found).select("root").distinct().count() == len(survivors(rows))


def test_parities_never_rule_out_a_near_copy(rows):
    sets = jaccard.shingle_sets([(t or "").encode() for _, t in rows])
    for a in sets[:150]:
        for b in sets[:150]:
            differ = len(np.setxor1d(a, b))
            assert np.bitwise_count((jaccard.parities(a) ^ jaccard.parities(b)).view(np.uint64)).sum() <= differ
            assert jaccard.parities_apart(jaccard.fine_parities(a), jaccard.fine_parities(b)) <= differ


def test_fine_parities_fold_to_the_shorter():
    a, b = (np.unique(np.random.default_rng(3).integers(0, 2**63, n).astype(np.uint64)) for n in (3000, 700))
    joined = np.concatenate((a, b))
    assert jaccard.parities_apart(jaccard.fine_parities(joined), jaccard.fine_parities(b)) <= len(a)
    assert jaccard.parities_apart(jaccard.fine_parities(a), jaccard.fine_parities(a)) == 0
