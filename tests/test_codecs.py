"""Additive, two-stage, fixed-level and spectral codes against plain versions."""

import numpy as np
import pytest

from lodestar.operators import additive, codecs, levels
from lodestar.plans import factory

RANDOM = np.random.default_rng(4)
V = RANDOM.normal(size=(400, 16)) * np.linspace(2, 0.2, 16)


def stored(codec, codes):
    return codec.from_bytes(b"".join(codec.row_bytes(codes)), len(codes), codec.width)


@pytest.mark.parametrize("search", [False, True])
def test_product_additive(search):
    codec = additive.ProductAdditive.train_on(V, 2, 3, 4, search)
    codes = codec.encode(V)
    back = stored(codec, codes)
    assert np.array_equal(back, codes) and len(codec.row_bytes(codes)[0]) == 2 * 3 * 4 // 8 + 4
    kept = codec.decode(codes)
    assert np.allclose(codes[:, -1], (kept * kept).sum(1), rtol=1e-5)
    q = RANDOM.normal(size=(5, 16))
    assert np.allclose(codec.distances(q, codes), ((q[:, None] - kept) ** 2).sum(2), atol=1e-4)
    assert np.allclose(codec.distances(q, codes, "ip"), q @ kept.T, atol=1e-4)
    assert np.allclose(codec.distances(q, codes, "l1"), np.abs(q[:, None] - kept).sum(2))
    plain = codecs.ProductQuantizer.train_on(V, 2, 4)
    assert ((kept - V) ** 2).sum() < ((plain.decode(plain.encode(V)) - V) ** 2).sum()
    with pytest.raises(ValueError):
        additive.ProductAdditive.train_on(V, 3, 2, 4)


def test_beams_of_many_rows_are_those_of_each():
    codec = codecs.ResidualQuantizer.train_on(V, 3, 4, beam=5)

    def one(x):
        beams = [((), x)]
        for book in codec.books:
            beams = sorted((((*c, j), left - b) for c, left in beams for j, b in enumerate(book)), key=lambda s: float((s[1] ** 2).sum()))[:5]
        return beams[0]

    got = codec.encode(V[:50])
    for x, c in zip(V, got):
        assert np.isclose(((x - sum(b[j] for b, j in zip(codec.books, c))) ** 2).sum(), (one(x)[1] ** 2).sum())
    assert codec.encode(V[:0]).shape == (0, 3)
    assert np.array_equal(np.concatenate([codec.encode(V[i : i + 7]) for i in range(0, 50, 7)])[:50], got[:50])


@pytest.mark.parametrize("bits,width", [(1, 9), (4, 6), (4, 7), (6, 5), (8, 3), (12, 4)])
def test_packed_rows(bits, width):
    codes = RANDOM.integers(0, 1 << bits, (20, width))
    rows = codecs.pack_rows(codes, bits)
    assert np.array_equal(codecs.unpack_rows(rows.tobytes(), 20, width, bits), codes)


def test_product_scans():
    codec = codecs.ProductQuantizer.train_on(V, 4, 4)
    codes, q = codec.encode(V), RANDOM.normal(size=(37, 16))
    assert np.allclose(codec.distances(q, codes), ((q[:, None] - codec.decode(codes)) ** 2).sum(2))
    assert np.allclose(codec.distances(q, codes, "ip"), q @ codec.decode(codes).T) and codec.distances(q[:0], codes).shape == (0, 400)


def test_two_stages():
    codec = additive.TwoStage.train_on(V, 4, 8, 4)
    codes = codec.encode(V)
    assert np.array_equal(stored(codec, codes), codes)
    q, kept = RANDOM.normal(size=(6, 16)), codec.decode(codes)
    exact, coarse = ((q[:, None] - kept) ** 2).sum(2), codec.first.distances(q, codes[:, :4])
    codec.keep = 25
    d = codec.distances(q, codes)
    for row, all_, first in zip(d, exact, coarse):
        short = np.argsort(first, kind="stable")[:25]
        assert set(np.flatnonzero(~np.isnan(row))) == set(short) and np.allclose(row[short], all_[short])
    codec.keep = 10_000
    assert np.allclose(codec.distances(q, codes), exact) and np.allclose(codec.distances(q, codes, "ip"), q @ kept.T)
    assert ((kept - V) ** 2).sum() < ((codec.first.decode(codes[:, :4]) - V) ** 2).sum()


@pytest.mark.parametrize("d,bits", [(8, 1), (64, 2), (64, 4), (300, 3)])
def test_levels_are_the_best(d, bits):
    level, cuts = levels.best_levels(d, bits)
    assert len(level) == 1 << bits and np.all(np.diff(level) > 0) and np.allclose(level, -level[::-1])
    x = RANDOM.normal(size=(200_000, d))[:, 0:1] if d > 200 else None
    unit = RANDOM.normal(size=(400_000 // d, d))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    lost = lambda lv: ((unit - lv[np.searchsorted((lv[1:] + lv[:-1]) / 2, unit)]) ** 2).mean()
    assert x is None or len(x)
    for scale in (0.85, 1.15):
        assert lost(level) < lost(level * scale)
    which = np.searchsorted(cuts, unit)
    assert np.allclose([unit[which == i].mean() for i in range(1 << bits)], level, atol=0.03 / np.sqrt(d) * 3)


def test_fixed_levels_keep_lengths():
    v = np.vstack([V, np.zeros((1, 16))])
    errors = []
    for bits in (1, 2, 3, 4, 8):
        codec = levels.FixedLevels(16, bits, codecs.random_rotation(16, 16))
        codes = codec.encode(v)
        assert np.array_equal(stored(codec, codes), codes) and not codec.decode(codes)[-1].any()
        errors.append(((codec.decode(codes) - v) ** 2).sum())
    assert errors == sorted(errors, reverse=True) and errors[-1] < errors[0] / 1000


def test_no_bits():
    codec = levels.ZeroBits(16)
    codes = codec.encode(V)
    assert codec.row_bytes(codes) == [b""] * len(V) and stored(codec, codes).shape == (len(V), 0)
    assert np.allclose(codec.distances(V[:3], codes), (V[:3] ** 2).sum(1)[:, None]) and not codec.distances(V[:3], codes, "ip").any()


@pytest.mark.parametrize("kind", "gchm")
def test_spectral_hash(kind):
    where, centroids = np.arange(len(V)) % 3, np.stack([V[i::3].mean(0) for i in range(3)])
    codec = levels.SpectralHash.train_on(V, where, centroids, codecs.Linear(np.eye(16)[:10]), 0.7, kind)
    for i in range(40):
        t = {"g": 0, "c": centroids[i % 3], "h": centroids[i % 3] - 0.175, "m": np.median(V[i % 3 :: 3], axis=0)}[kind]
        assert codec.encode_in(V[i : i + 1], where[i : i + 1])[0].tolist() == [int(np.floor(x / 0.35)) % 2 for x in (V[i] - t)[:10]]
    a, b = codec.encode_in(V[:4], np.full(4, 1)), codec.encode_in(V, np.full(len(V), 1))
    assert np.array_equal(codec.distances_in(V[:4], b, 1), (a[:, None] != b).sum(2))


@pytest.mark.parametrize("text,size", [("PRQ2x4x6", 10), ("PLSQ2x4x6", 10), ("IVF16,PRQ4x2x6", 11), ("SQtqmse4", 36), ("IVF16,SQ0", 1), ("IVF16,PQ8+16x8", 25), ("IVF16,ITQ32,SH1.5c", 5), ("IVF16,SH0.5g", 9)])
def test_strings(text, size):
    spec = factory.parse(text)
    assert str(spec) == text and factory.code_size(spec, 64) == size and factory.parse(str(spec)) == spec


@pytest.mark.parametrize("text", ["SQ0", "PQ8+16", "SH1g", "IMI2x4,SH1g", "IVF16,Flat,Refine(SQ0)", "HNSW32,SQ0", "SQtqmse9", "PRQ2x4"])
def test_refused(text):
    with pytest.raises(ValueError):
        factory.parse(text)
