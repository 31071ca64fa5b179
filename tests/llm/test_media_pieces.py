"""Round trips of the media store and the piece encoder, and the distribution of sampled segmentations."""

import collections
import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tremor.llm import jpeg, media, pieces


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1500))
def test_payload_comes_back(raw):
    payload = media.pad64(raw)
    assert len(payload) % 64 == 0 and len(payload) >= 64
    got, frame = media.load(media.store(payload))
    assert got == payload
    assert jpeg.to_rgb(frame).shape == (frame.height, frame.width, 3)


@pytest.mark.parametrize("sampling,width,height", [([(2, 2), (1, 1), (1, 1)], 50, 37), ([(1, 1)], 19, 23), ([(2, 1), (1, 1), (1, 1)], 33, 17)])
@pytest.mark.parametrize("al", [1, 2])
@pytest.mark.parametrize("density", [0.0, 0.05, 0.4, 1.0])
def test_any_coefficients_come_back(sampling, width, height, al, density):
    rng = np.random.default_rng(3)
    frame = jpeg.Frame(width, height, sampling, [np.arange(1, 65), np.full(64, 3)][: min(2, len(sampling))])
    for c in frame.coef:
        c[:] = np.where(rng.random(c.shape) < density, rng.integers(-150, 150, c.shape), 0)
    got, comment = jpeg.decode(jpeg.encode(frame, b"note", al))
    assert comment == b"note"
    for k, (a, b) in enumerate(zip(frame.coef, got.coef, strict=True)):
        real = frame.blocks([k])[0][1].ravel()
        assert (a.reshape(-1, 64)[real] == b.reshape(-1, 64)[real]).all()
        assert (a[..., 0] == b[..., 0]).all()


def test_inverse_transform_by_the_formula():
    frame = jpeg.Frame(8, 8, [(1, 1)], [np.full(64, 2)])
    rng = np.random.default_rng(0)
    frame.coef[0][0, 0] = rng.integers(-20, 20, 64)
    f = np.zeros(64)
    f[jpeg.ZIGZAG] = frame.coef[0][0, 0] * 2.0
    f = f.reshape(8, 8)
    c = lambda k: np.sqrt(0.5) if k == 0 else 1.0
    for y in range(8):
        for x in range(8):
            v = sum(c(u) * c(w) * f[w, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * w * np.pi / 16) for u in range(8) for w in range(8)) / 4 + 128
            assert abs(jpeg.to_rgb(frame)[y, x, 0] - np.clip(v, 0, 255)) <= 0.51


def test_media_report(docs):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "héllo"), (5, "z" * 100_000)]
    got = {r.doc_id: r for r in media.media_digest(docs(rows, extra=True)).collect()}
    payload = "héllo".encode() + bytes(58)
    assert (got[1].n_bytes, got[1].payload_bytes, got[1].payload_sha256, got[1].tail_crc32) == (6, 64, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload))
    assert got[1][1:] == got[4][1:] and got[2][1:] == got[3][1:]
    assert (got[3].n_bytes, got[3].payload_bytes) == (0, 64)
    kept = media.media_columns(docs(rows[:1])).collect()[0]
    assert hashlib.sha256(kept.media).hexdigest() == got[1].media_sha256 and len(kept.rgb) == kept.height * kept.width * 3
    images = media.decode_images(media.media_columns(docs(rows[:1])).selectExpr("doc_id", "media").union(docs([(9, "x")]).selectExpr("doc_id", "cast('no' as binary)")), "doc_id", "media")
    by = {r.doc_id: r for r in images.collect()}
    assert bytes(by[1].rgb) == bytes(kept.rgb) and by[9].rgb is None and by[9].error
    assert media.media_digest(docs([])).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["the ", " ", "▁", "\n", "é", "中", "😀", "x" * 70, "and"]), max_size=12).map("".join))
def test_decoding_is_lossless(vocabulary, text):
    ids = pieces.encode_texts([5], [text], vocabulary, 0.8, 1)[0]
    assert pieces.decode_ids(ids.tolist(), vocabulary) == text


def test_segmentations_follow_their_weights(vocabulary):
    word, n = " theend", 40_000
    index = {p: i for i, (p, k) in enumerate(zip(vocabulary.pieces, vocabulary.kinds, strict=True)) if k == "piece"}

    def every(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in index:
                for rest in every(s[k:]):
                    yield (index[s[:k]], *rest)

    weights = {g: float(np.prod(vocabulary.weight[list(g)] ** 0.8)) for g in every("▁▁theend")}
    total = sum(weights.values())
    got = collections.Counter(tuple(x.tolist()) for x in pieces.encode_texts(list(range(n)), [word] * n, vocabulary, 0.8, 1))
    assert set(got) <= set(weights)
    for g, w in weights.items():
        p = w / total
        assert abs(got[g] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_rows_decide_alone(spark, docs, vocabulary):
    texts = [f"the quick brown fox {i} jumps over" for i in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "a" * 50_000)]
    df = docs(rows, extra=True)
    a = {r.doc_id: r for r in pieces.encode_pieces(df).collect()}
    b = {r.doc_id: r for r in pieces.encode_pieces(df.repartition(7)).collect()}
    assert a == b and all(r.lossless for r in a.values())
    assert a[900].ids is None and a[901].ids == [] and a[900].n_pieces == 0
    back = {r.doc_id: r.text for r in pieces.decode_pieces(pieces.encode_pieces(df)).collect()}
    assert back == dict(rows)
    other = pieces.encode_pieces(df, seed=2).filter("doc_id < 200").collect()
    assert any(a[r.doc_id].ids != r.ids for r in other)
    assert pieces.encode_pieces(docs([])).count() == 0


def unbroken(rng, n):
    words = ["".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    return "".join(rng.choice(words) for _ in range(n // 2))[:n]


@pytest.mark.parametrize("alpha", [0.0, 0.8, 3.0])
def test_long_parts_are_drawn_like_short_ones(vocabulary, monkeypatch, alpha):
    """Parts that go node by node give the ids they would have beside all others."""
    rng = random.Random(5)
    texts = [unbroken(rng, 9000), unbroken(rng, 2001), "ordinary words " * 30, unbroken(rng, 2500) + " and " + unbroken(rng, 4000), "a" * 5000, "漢字" * 2000, unbroken(rng, 9000)]
    keys = list(range(len(texts)))
    apart = pieces.encode_texts(keys, texts, vocabulary, alpha, 1)
    assert all(pieces.decode_ids(x.tolist(), vocabulary) == t for x, t in zip(apart, texts, strict=True))
    monkeypatch.setattr(pieces, "LONG", 10**9)
    together = pieces.encode_texts(keys, texts, vocabulary, alpha, 1)
    assert all(np.array_equal(x, y) for x, y in zip(apart, together, strict=True))


def test_an_unbroken_word_of_a_million_characters(vocabulary):
    text = unbroken(random.Random(6), 1_000_000)
    began = time.process_time()
    ids = pieces.encode_texts([1], [text], vocabulary, 0.8, 1)[0]
    assert time.process_time() - began < 12 and pieces.decode_ids(ids.tolist(), vocabulary) == text


@pytest.mark.parametrize(("sampling", "width", "height"), [([(2, 2), (1, 1), (1, 1)], 37, 29), ([(2, 1), (1, 1), (1, 1)], 20, 11), ([(1, 1), (1, 1), (1, 1)], 9, 9)])
def test_colours_by_the_formula(sampling, width, height):
    """Every pixel from its definition: the block's cosine sum, the chroma sample that covers the pixel, and the conversion from YCbCr."""
    rng = np.random.default_rng(1)
    frame = jpeg.Frame(width, height, sampling, [rng.integers(1, 9, 64), rng.integers(1, 9, 64), rng.integers(1, 9, 64)])
    for c in frame.coef:
        c[:] = np.where(rng.random(c.shape) < 0.15, rng.integers(-12, 12, c.shape), 0)
        c[:, :, 0] = rng.integers(-60, 60, c.shape[:2])
    turn = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
    planes = []
    for k, c in enumerate(frame.coef):
        plane = np.zeros((c.shape[0] * 8, c.shape[1] * 8))
        for i in range(c.shape[0]):
            for j in range(c.shape[1]):
                f = np.zeros(64)
                f[jpeg.ZIGZAG] = c[i, j] * frame.quant[k]
                plane[8 * i : 8 * i + 8, 8 * j : 8 * j + 8] = turn @ f.reshape(8, 8) @ turn.T + 128
        planes.append(np.clip(plane, 0, 255))
    rgb = jpeg.to_rgb(frame)
    hmax, vmax = sampling[0]
    for y in range(height):
        for x in range(width):
            lum, cb, cr = (planes[k][y * v // vmax, x * h // hmax] for k, (h, v) in enumerate(sampling))
            want = (lum + 1.402 * (cr - 128), lum - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), lum + 1.772 * (cb - 128))
            assert all(abs(int(rgb[y, x, k]) - min(255, max(0, w))) <= 0.51 for k, w in enumerate(want))
