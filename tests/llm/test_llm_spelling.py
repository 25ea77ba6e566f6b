"""Spelling variants against plain loops."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import spelling as S

rng = np.random.default_rng(5)


def plain(rows, least_length=7, least_count=2, times=10, slips=31):
    count = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(low)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % slips == 0:
                p = h % len(w)
                w = w[:p] + w[p + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    beside = {w: [u for u in words if u != w and near(u, w)] for w in words}
    form = {}
    for w, own in beside.items():
        best = min(own, key=lambda u: (-words[u], u), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(beside[w]), words.get(form[w])) for w, n in words.items()}


def typo(w):
    p, k, c = rng.integers(0, len(w)), rng.integers(0, 3), str(rng.choice(list("abeéÿÀz")))
    return w[:p] + [c + w[p:], c + w[p + 1 :], w[p + 1 :]][k]


def corpus():
    words = ["committee", "accommodate", "Straßenbahn", "necessary", "aaaaaaaa", "aaaaaaab", "bookkeeper", "a" * 300, "ab" * 150, "ÀÉÎõüÿñ", "short", "sixsix"]
    rows = []
    for i in range(160):
        own = []
        for _ in range(int(rng.integers(0, 90))):
            w = str(rng.choice(words[:7] + words[9:])) if rng.random() < 0.9 else str(rng.choice(words))
            own.append(typo(w) if rng.random() < 0.12 else w)
        rows.append((i, "  ".join(own)))
    return rows + rows[:20] + [(900, None), (901, ""), (None, "committee committee 1committee2"), (None, None), (902, "committee×÷ " * 3), (903, "bookkeepers " * 400 + "x" * 3000)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n long, word string")


def test_variants_against_plain_loops(spark, rows):
    got = {tuple(r) for r in S.variants(frame(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = plain(rows)
    assert got == want and any(x[1] for x in want) and len(got) == S.variants(frame(spark, rows)).count()


def test_chains_of_forms(spark):
    text = "relatives " * 1000 + "relativas " * 90 + "relativos " * 1 + "rellativas " * 5
    rows = [(1, text), (2, "rellativasx rellativasx")]
    got = {tuple(r) for r in S.variants(frame(spark, rows), times=2, slips=2**33).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain(rows, times=2, slips=2**33)
    assert ("rellativasx", "rellativas", "relatives", 2, 1, 5) in got


def test_empty_tables(spark):
    assert S.variants(frame(spark, [(1, "one two")])).count() == 0
    assert S.variants(frame(spark, [(1, None)]).limit(0)).count() == 0
