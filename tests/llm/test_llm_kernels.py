"""Kernels against brute force: anchors, fingerprints, suffix sorting, cover trees, wavelets, packing, JPEG."""

import numpy as np
import pytest
import xxhash

from tesserae.llm import embeddings, jpeg, media, packing, simhash, suffixes, tokens, wavelet
from tesserae.llm.common import anchors


def test_windows_alike_have_one_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 2**63, 400).astype(np.uint64)
    x[300:360] = x[100:160]
    got = anchors(x, np.array([0, 200, 400]), 50, 8)
    at = {int(w): int(a) for lo, hi, a in zip(got["lo"], got["hi"], got["at"]) for w in range(lo, hi + 1)}
    assert sorted(at) == [*range(151), *range(200, 351)]
    assert all(at[100 + i] - 100 == at[300 + i] - 300 for i in range(11))


def test_fingerprints_are_majorities():
    rng = np.random.default_rng(2)
    texts = [b" ".join(rng.choice([b"a", b"Bc", b"d", b"xyz"], size=n)) for n in (0, 1, 2, 3, 4, 255, 258, 700)]
    for t, got in zip(texts, simhash.fingerprints_of(texts).tolist()):
        w = t.lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        assert got == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_gray_index_finds_components():
    rng = np.random.default_rng(3)
    one = np.uint64(1)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)[rng.integers(0, 4, 600)]
    f = np.unique(base ^ (one << rng.integers(0, 12, 600).astype(np.uint64)) ^ (one << rng.integers(0, 12, 600).astype(np.uint64)))
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    label = np.arange(len(f))
    while (new := np.array([label[n].min() for n in near])).tolist() != label.tolist():
        label = new
    assert len({*zip(label.tolist(), simhash.local_roots(f).tolist())}) == len({*label.tolist()})


def test_suffixes_against_dictionary():
    rng = np.random.default_rng(4)
    for letters in (1, 2, 4):
        t = rng.integers(97, 97 + letters, 1500).astype(np.uint8)
        t[900:1200] = t[100:400]
        at = np.sort(rng.choice(1401, 900, replace=False))
        age, raw, least = rng.permutation(len(at)), t.tobytes(), {}
        for p, a in zip(at, age):
            least[raw[p : p + 100]] = min(least.get(raw[p : p + 100], 10**9), a)
        want = [a > least[raw[p : p + 100]] for p, a in zip(at, age)]
        assert suffixes.later_suffixes(t, at, age, 100, 50).tolist() == want


def test_cover_trees_lose_no_link():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 8))
    x[:200] = x[0] + rng.normal(size=(200, 8)) * 0.2
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    t = embeddings.CoverTree.from_bytes(embeddings.CoverTree(x).to_bytes())
    links = embeddings.Links(np.ones(500, dtype=np.int64))
    embeddings.traverse(t, t, 0.95, links, 0)
    degree = np.zeros(500, dtype=int)
    degree[t.label] = links.degree[:500]
    assert degree.tolist() == s.sum(axis=1).tolist()
    # a part of a tree finds what its points link with
    some = np.arange(0, 500, 3)
    part = embeddings.CoverTree.from_bytes(t.part(some).to_bytes())
    links = embeddings.Links(np.ones(len(part.label) + 500, dtype=np.int64))
    embeddings.traverse(part, t, 0.95, links, len(part.label))
    got = {int(l): int(d) for l, d in zip(part.label, links.degree)}
    assert [got[i] for i in some.tolist()] == [int(s[i].sum()) + 1 for i in some.tolist()]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 4000])
def test_wavelet_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50257).astype(np.uint32)
    lengths = np.array([1] * min(n, 3) + [n - 3] * (n > 3), dtype=np.int64)
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, lengths).to_bytes())
    assert (w.decode() == ids).all()
    starts, got = w.documents()
    assert got.tolist() == lengths.tolist() and starts.tolist() == (np.cumsum(lengths) - lengths).tolist()
    if n:
        i = rng.integers(0, n, 20)
        assert (w.access(i) == ids[i]).all()
        for token in (int(ids[0]), 49999):
            assert w.count(token) == (ids == token).sum()
            assert w.count(token, n // 3, n // 2) == (ids[n // 3 : n // 2] == token).sum()
            assert (w.occurrences(token) == np.flatnonzero(ids == token)).all()


def test_rank_and_select():
    rng = np.random.default_rng(9)
    bits = rng.random(3000) < 0.3
    v = wavelet.BitVector.pack(bits)
    assert v.rank(np.arange(3000)).tolist() == (np.cumsum(bits) - bits).tolist()
    for bit in (0, 1):
        at = np.flatnonzero(bits == bit)
        assert v.select(bit, np.arange(len(at))).tolist() == at.tolist()


def test_packing_fits_and_is_near_its_bound():
    s = np.random.default_rng(6).integers(1, 1000, 3000)
    b, at, n = packing.best_fit_decreasing(s)
    least = packing.lower_bound(np.bincount(s, minlength=2049))
    assert np.bincount(b, s).max() <= 2048 and least <= n <= least + 3
    assert all(a == s[(b == k) & (at < a)].sum() for k, a in zip(b[:200], at[:200]))


def test_encoder_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    rng = np.random.default_rng(7)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "B", "é", "É", "×", "'s", "'", "don't", "1", "23", ".", ",", "_", "\u00a0", "\u3000", "\u2028", "\x85", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "\u0301", "中", "ß", "Σ", "\x1c", "🙂"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(4000)] + ["word " * 700_000 + "end", "中" * 5000]
    raw = [t.encode() for t in texts]
    for path in (wavelet.byte_tokenizer(), packing.word_tokenizer()):
        want = [[*x.ids, 0] for x in tokenizers.Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        for kept in (20, 10**6):
            encoder = tokens.PieceEncoder(path, 0, kept)
            for step in (700, len(raw)):
                got = []
                for a in range(0, len(raw), step):
                    ids, ends = encoder.encode(raw[a : a + step])
                    got += [x.tolist() for x in np.split(ids, ends[:-1])]
                assert got == want


def test_jpeg_keeps_every_byte():
    rng = np.random.default_rng(8)
    texts = [b"", b"hello world " * 90, rng.integers(0, 256, 3000).astype(np.uint8).tobytes(), b"\x80" * 1500, b"\x81\x80" * 2000, rng.integers(126, 131, 4000).astype(np.uint8).tobytes()]
    payloads = [media.payload_of(t) for t in texts]
    files = jpeg.encode(payloads)
    images, v, base = jpeg.decode_coefficients(files)
    assert jpeg.payloads_of(images, v, base) == payloads
    assert [t.shape for t in jpeg.tensors(images, v, base)] == [(i.height, i.width, 3) for i in images]
    assert [jpeg.encode([p])[0] for p in payloads] == files
