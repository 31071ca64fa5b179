"""Denoising quality, baselines and paired tests on small exact cases."""

import itertools

import numpy as np
import pytest

from tremor.operators import baselines as B
from tremor.operators import detection as D
from tremor.operators import search as R


@pytest.mark.parametrize(("n", "width"), [(64, 32), (200, 50), (257, 64), (1000, 256), (33, 33), (100, 37)])
def test_overlap_add_gives_the_signal_back(n, width):
    x = np.random.default_rng(n).normal(size=n)
    assert np.abs(B.overlap_add(*B.frames_of(x, width), n) - x).max() < 1e-12


def test_spectral_threshold_keeps_a_tone():
    t = np.arange(4000) / 1000
    tone, noise = np.sin(2 * np.pi * 125 * t), 0.05 * np.random.default_rng(1).normal(size=4000)
    made = B.spectral_threshold(tone + noise)
    assert len(made) == 4000 and np.std(made - tone) < 0.5 * np.std(noise)
    assert not B.spectral_threshold(np.zeros(100)).any()


def test_quality_takes_the_gain_out():
    rng = np.random.default_rng(2)
    clean = np.sin(2 * np.pi * 125 * np.arange(1000) / 1000) * (np.arange(1000) > 400)
    same = dict(zip(R.QUALITY, R.quality_of(clean, 0.3 * clean, 1000.0, (75.0, 175.0), 0.4), strict=True))
    assert same["rmse"] < 1e-12 and same["snr_db"] > 250 and same["spectral_distortion"] < 1e-9
    assert same["chatter_band_retention"] == pytest.approx(1) and same["noise_band_attenuation"] == pytest.approx(0, abs=1e-9) and same["onset_detection_error"] < 0.03
    noisy = clean + 0.3 * rng.normal(size=1000)
    rmse, snr, *_ = R.quality_of(clean, noisy, 1000.0, (75.0, 175.0), None)
    gain = clean @ noisy / (noisy @ noisy)
    assert rmse == pytest.approx(np.sqrt(np.mean((clean - gain * noisy) ** 2))) and snr == pytest.approx(10 * np.log10(clean.var() / (clean - gain * noisy).var()))
    assert R.quality_of(clean, np.zeros(1000), 1000.0, (75.0, 175.0), 0.4)[3] == 0 and R.quality_of(clean, clean, 1000.0, (75.0, 175.0), None)[5] is None


def test_selected_modes():
    t = np.arange(256) / 256
    layers = np.stack([np.sin(2 * np.pi * f * t) for f in (60, 20, 3)] + [t])
    assert np.allclose(B.selected_modes(layers, 256.0, 15, 30), layers[1])
    assert np.allclose(B.selected_modes(layers, 256.0, 100, 120), layers[:3].sum(0))
    assert not B.selected_modes(layers[3:], 256.0, 1, 2).any()


def test_benchmark_has_every_cell(spark):
    t = np.arange(128) / 128
    rows = spark.createDataFrame([(i, (np.sin(2 * np.pi * (12 + i) * t) * (1 + i)).tolist()) for i in range(3)], "recording_id long, reference array<double>")
    run = lambda: {(r.noise, r.method): r for r in B.benchmark(rows, [0.05, 1.0], 128.0, (4.0, 50.0), (8.0, 20.0), "db2", 2, ("db2", 2), onset_s=0.1).collect()}
    found = run()
    assert set(found) == set(itertools.product((0.05, 1.0), B.METHODS)) and all(r.recordings == 3 for r in found.values())
    assert all(np.isfinite(r[q]) for r in found.values() for q in R.QUALITY if r[q] is not None)
    assert all(found[0.05, m].snr_db > found[1.0, m].snr_db for m in ("raw", "butterworth_only", "ceemdan_only"))
    assert found[1.0, "butterworth_only"].snr_db > found[1.0, "raw"].snr_db  # the band holds the tone
    assert found[0.05, "raw"].snr_db == pytest.approx(26, abs=1.5)
    again = run()
    assert all(found[k].snr_db == pytest.approx(again[k].snr_db, rel=1e-9) for k in found)


@pytest.mark.parametrize(("n", "minus", "p"), [(5, 0, 0.0625), (6, 0, 0.03125), (8, 3, 0.0390625), (10, 8, 0.048828125), (12, 13, 0.04248046875)])
def test_small_samples_have_the_published_tails(spark, n, minus, p):
    """Two-sided tails of the signed-rank table: the chosen ranks get a negative sign."""
    signs, left = {}, minus
    for rank in range(n, 0, -1):
        signs[rank] = -1 if rank <= left else 1
        left -= rank if rank <= left else 0
    rows = spark.createDataFrame([(float(s * r), 0.0) for r, s in signs.items()], "a double, b double")
    got = D.wilcoxon(rows, "a", "b").collect()[0]
    assert (got.n, got.minus, got.plus) == (n, minus, n * (n + 1) / 2 - minus) and got.p_value == pytest.approx(p)
    greater = D.wilcoxon(rows, "a", "b", "greater").collect()[0]
    assert greater.statistic == got.plus and greater.p_value == pytest.approx(p / 2)
    assert sum(D.rank_sum_counts(n)) == 2**n


def test_ties_and_zeros(spark):
    d = [1.0, -1.0, 1.0, 2.0, 2.0, -2.0, 3.0, 0.0, 0.0, 4.0, None, float("nan")] * 5
    got = D.wilcoxon(spark.createDataFrame([(v, 0.0) for v in d], "a double, b double").repartition(4), "a", "b", "greater").collect()[0]
    x = np.array([v for v in d if v is not None and v == v and v != 0])
    ranks = np.array([(np.abs(x) < abs(v)).sum() + ((np.abs(x) == abs(v)).sum() + 1) / 2 for v in x])
    n, plus = len(x), ranks[x > 0].sum()
    ties = sum((np.abs(x) == v).sum() ** 3 - (np.abs(x) == v).sum() for v in np.unique(np.abs(x)))
    z = (plus - n * (n + 1) / 4) / np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert (got.n, got.plus, got.minus) == (n, plus, ranks[x < 0].sum()) and got.z == pytest.approx(z) and got.p_value < 0.01
    none = D.wilcoxon(spark.createDataFrame([(1.0, 1.0)], "a double, b double"), "a", "b").collect()[0]
    assert none.n == 0 and none.p_value == 1.0
