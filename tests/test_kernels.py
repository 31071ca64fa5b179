"""Numeric kernels against definitions, exact inverses and analytic signals."""

import itertools
import time

import numpy as np
import pytest

from tremor.functions import kernels as K
from tremor.operators.spectral import welch


@pytest.mark.parametrize("name", ["db1", "db2", "db4", "db8"])
@pytest.mark.parametrize("n", [64, 101, 257, 1001])
def test_wavelet_round_trip(name, n):
    x = np.random.default_rng(n).normal(size=n)
    bands = K.dwt(x, name, 4)
    assert np.abs(K.idwt([c for _, _, c in bands], name, n) - x).max() < 1e-10
    lo, hi = K.filters(name)
    assert abs(lo @ lo - 1) < 1e-9 and abs(lo @ hi) < 1e-9


def test_wavelet_lengths_and_names():
    assert [len(c) for _, _, c in K.dwt(np.zeros(10_000), "db8", 4)] == [639, 639, 1263, 2511, 5007]
    with pytest.raises(ValueError):
        K.filters("haarish")
    assert np.abs(K.wavelet_denoise(np.zeros(512), "db2", 2, 100.0, None)).max() == 0
    assert K.shrink_threshold(np.zeros(8), 0.1) == 0.0


def test_bandpass_passes_its_band_only():
    fs, t = 1000.0, np.arange(2000) / 1000
    tones = {f: np.sin(2 * np.pi * f * t) for f in (5, 100, 400)}
    y = K.bandpass(sum(tones.values()), 50, 200, fs)
    assert np.abs(y - tones[100])[200:-200].max() < 1e-4  # unit gain, no delay
    for bad in ((0, 10), (20, 10), (10, 600)):
        with pytest.raises(ValueError):
            K.bandpass(t, *bad, fs)
    line = K.detrend(3 + 2 * t)
    assert np.abs(line).max() < 1e-9


def test_envelope_and_growth():
    t = np.arange(1000) / 1000
    assert np.abs(K.envelope(0.7 * np.cos(2 * np.pi * 50 * t)) - 0.7).max() < 1e-9
    growing, steady = K.energy_growth(t * np.sin(2 * np.pi * 125 * t), 1000), K.energy_growth(np.sin(2 * np.pi * 125 * t), 1000)
    assert growing > 10 * max(steady, 0.01)


def test_welch_by_definition():
    x = np.random.default_rng(5).normal(size=200)
    n, fs = 64, 100.0
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    total = np.zeros(33)
    starts = range(0, 200 - n + 1, 32)
    for s in starts:
        seg = (x[s : s + n] - x[s : s + n].mean()) * w
        for k in range(33):
            z = sum(seg[i] * np.exp(-2j * np.pi * k * i / n) for i in range(n))
            total[k] += abs(z) ** 2 / (fs * (w * w).sum()) * (1 if k in (0, 32) else 2)
    assert np.allclose(welch(x, fs, n), total / len(starts))


def test_ensemble_modes_keep_the_signal():
    t = np.arange(600) / 1000
    x = np.sin(2 * np.pi * 100 * t) + np.sin(2 * np.pi * 5 * t)
    a, b = K.ensemble_modes(x, 20, seed=3), K.ensemble_modes(x, 20, seed=3)
    assert len(a) >= 2 and np.allclose(sum(a), x, rtol=1e-7, atol=1e-10)
    assert all((p == q).all() for p, q in zip(a, b, strict=True))
    assert len(K.ensemble_modes(np.ones(64))) == 1  # nothing oscillates: the residual alone


def test_splines_of_many_rows_by_dense_systems():
    rng = np.random.default_rng(4)
    h = rng.normal(size=(7, 90)).cumsum(axis=1)
    d = np.diff(h, axis=1)
    mark = np.zeros(h.shape, dtype=bool)
    mark[:, 1:-1] = (d[:, :-1] > 0) & (d[:, 1:] <= 0)
    got = K._spline_rows(mark, h)
    for row, marked, made in zip(h, mark, got, strict=True):
        p = np.flatnonzero(marked)
        at = np.concatenate([[-p[1], -p[0]], p, [2 * 89 - p[-1], 2 * 89 - p[-2]]]).astype(float)
        v = row[np.concatenate([[p[1], p[0]], p, [p[-1], p[-2]]])]
        g, m = np.diff(at), len(at)
        a, r = np.eye(m), np.zeros(m)
        for i in range(1, m - 1):
            a[i, i - 1 : i + 2] = g[i - 1], 2 * (g[i - 1] + g[i]), g[i]
            r[i] = 3 * ((v[i + 1] - v[i]) / g[i] - (v[i] - v[i - 1]) / g[i - 1])
        c = np.linalg.solve(a, r)
        for x in range(90):
            k = max(j for j in range(m - 1) if at[j] <= x)
            b = (v[k + 1] - v[k]) / g[k] - g[k] * (2 * c[k] + c[k + 1]) / 3
            t = x - at[k]
            assert abs(v[k] + t * (b + t * (c[k] + t * (c[k + 1] - c[k]) / (3 * g[k]))) - made[x]) < 1e-9


def test_trials_go_in_batches(monkeypatch):
    x = np.random.default_rng(2).normal(size=200).cumsum()
    rows = np.stack([x, np.sin(np.arange(200)), np.ones(200)])
    both, found = K.local_means(rows, 5)
    assert found.tolist() == [True, True, False]
    assert np.allclose(both[0], K.local_means(rows[:1], 5)[0][0], atol=1e-12)
    monkeypatch.setattr(K, "BATCH", 1000)
    assert np.allclose(sum(K.ensemble_modes(x, 12)), x)


def test_many_signals_are_decomposed_at_once():
    x = np.random.default_rng(8).normal(size=(160, 64))
    x[5] = 1.0  # nothing oscillates
    x[6] = np.sin(np.arange(64) / 2)
    K.ensemble_modes(x[0], 15, 0.02, 42)
    began = time.process_time()
    got = K.ensembles(x, 15, 0.02, 42)
    assert time.process_time() - began < 4  # 160 rows one by one took 11 s
    assert len(got[5]) == 1 and (got[5][0] == 1).all()
    for row, made in zip(x[:12], got, strict=False):
        alone = K.ensemble_modes(row, 15, 0.02, 42)
        assert len(made) == len(alone) and all(np.allclose(p, q, atol=1e-12) for p, q in zip(made, alone, strict=True))
        assert np.allclose(sum(made), row)


def test_filter_blocks_follow_the_recursion():
    x = np.random.default_rng(3).normal(size=333)
    for b0, b1, b2, a1, a2 in K.bandpass_sections(20, 200, 1000.0, 3):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z1, z2, out = (gain - b0) * x[0], (b2 - a2 * gain) * x[0], []
        for v in x:
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            out.append(y)
        assert np.allclose(K._section(x, (b0, b1, b2, a1, a2), x[0]), out, atol=1e-10)


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        c = rng.random((rng.integers(1, 6), rng.integers(1, 6)))
        pairs = K.assign(c)
        short, long = sorted(c.shape)
        d = c if c.shape[0] <= c.shape[1] else c.T
        best = min(sum(d[i, p[i]] for i in range(short)) for p in itertools.permutations(range(long), short))
        assert len(pairs) == short and abs(sum(c[i, j] for i, j in pairs) - best) < 1e-12


def test_preprocessing(spark):
    from tremor.operators import decompose as C

    t = np.arange(400) / 200
    x = 3 + 2 * t + np.sin(2 * np.pi * 20 * t)
    rows = spark.createDataFrame([(1, x.tolist()), (2, [0.0] * 400), (3, [float("nan")] + [1.0] * 399), (4, [1.0])], "recording_id int, x array<double>")
    found = {r.recording_id: r for r in C.preprocess(rows, 5.0, 200.0).collect()}
    assert C.automatic_low_pass(200.0) == 90.0 and C.automatic_low_pass(20_000.0) == 4000.0
    want = K.detrend(K.bandpass(x, 5.0, 90.0, 200.0, 3))
    assert np.allclose(found[1].physical, want) and found[1].scale_factor == pytest.approx(np.percentile(np.abs(want), 99.5)) and np.allclose(np.array(found[1].scaled) * found[1].scale_factor, want)
    assert "amplitude" in found[2].error and "finite" in found[3].error and "short" in found[4].error and all(found[k].scaled is None for k in (2, 3, 4))
    first = C.preprocess(rows.filter("recording_id = 1"), 5.0, 200.0, 50.0, trend="constant", trend_first=True, percentile=100.0).collect()[0]
    want = K.bandpass(x - x.mean(), 5.0, 50.0, 200.0, 3)
    assert np.allclose(first.physical, want) and np.abs(first.scaled).max() == pytest.approx(1)
    for bad in ({"trend": "cubic"}, {"percentile": 0.0}, {"high": 100.0}):
        with pytest.raises(ValueError):
            C.preprocess(rows, 5.0, 200.0, **bad)


def test_results_go_on_in_pieces(spark):
    from pyspark.sql import functions as F

    from tremor.operators import spectral

    rows = spark.range(0, 5000, 1, 1).select("id", F.when(F.col("id") != 7, F.array_repeat(F.col("id").cast("double"), 64)).alias("x"))
    made = spectral.map_many(rows, lambda values: [(float(v[0]), len(values)) for v in values], [spectral.T.StructField("first", spectral.T.DoubleType()), spectral.T.StructField("together", spectral.T.IntegerType())]).collect()
    assert all(r.first == (None if r.id == 7 else r.id) for r in made) and len(made) == 5000
    assert max(r.together or 0 for r in made) * 64 <= spectral.PIECE * 1.01


def test_metrics_of_odd_modes(spark):
    from tremor.operators import stage4

    flat, wave = [2.0] * 64, np.sin(np.arange(64) * 0.7).tolist()
    rows = spark.createDataFrame([(1, wave, [wave, flat, wave]), (2, wave, [wave]), (3, wave, [wave, flat])], "recording_id int, source array<double>, layers array<array<double>>").selectExpr("*", "CAST(NULL AS DOUBLE) AS rpm", "CAST(NULL AS DOUBLE) AS tooth_count")
    got = {r.recording_id: r for r in stage4.layer_metrics(rows, 64.0, (8.0, 20.0), 4, 0.5).collect()}
    first, still = got[1].metrics
    assert first.correlation == pytest.approx(1) and still.correlation is None and still.kurtosis is None and still.entropy is None and still.centre_hz == 0
    assert got[1].adjacent_mean is None and got[2].metrics == [] and got[2].spectral_overlap == 0 and len(got[3].metrics) == 1


def test_both_envelopes_are_solved_at_once(monkeypatch):
    solve, asked = K._tridiagonal, []
    monkeypatch.setattr(K, "_tridiagonal", lambda g, *rest: asked.append(g.shape[1]) or solve(g, *rest))
    h = np.random.default_rng(5).normal(size=(64, 100))
    assert K.sifted(h, 3).all() and asked == [200] * 3


@pytest.mark.parametrize("columns", [1, 70])
def test_one_sift_by_its_definition(columns):
    h = np.random.default_rng(6).normal(size=(50, columns)).cumsum(axis=0)
    want, d = h.T.copy(), np.diff(h.T, axis=1)
    top, low = np.zeros((2, columns, 50), dtype=bool)
    top[:, 1:-1], low[:, 1:-1] = (d[:, :-1] > 0) & (d[:, 1:] <= 0), (d[:, :-1] < 0) & (d[:, 1:] >= 0)
    ok = (top.sum(1) >= 2) & (low.sum(1) >= 2)
    want[ok] -= (K._spline_rows(top[ok], want[ok]) + K._spline_rows(low[ok], want[ok])) / 2
    assert (K.sifted(h, 1) == ok).all() and np.allclose(h.T, want, atol=1e-12)


def test_stability_of_the_grid_is_worked_out_once(spark):
    from tremor.operators import search as R

    rows = spark.createDataFrame([(k, np.random.default_rng(k).normal(size=64).tolist()) for k in range(2)], "recording_id int, x array<double>")
    made = R.cutoff_grid(rows, [2.0, 4.0], [42, 43], 24.0, 64.0, (8.0, 20.0), trials=2, sifts=2)
    assert "MapInArrow" not in made._jdf.queryExecution().toString()  # it is read twice: by seed and for the means
    assert made.count() == 4


@pytest.mark.parametrize("name", ["full_pipeline_features", "dynamic_pipeline_features"])
def test_the_whole_chain_takes_all_trials(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from tremor.operators import search as R

    class Seen(Exception):
        pass

    def decompose(rows, keys, trials=300, sifts=16, **more):
        raise Seen(trials, sifts, more)

    monkeypatch.setattr(R, "decompose", decompose)
    with pytest.raises(Seen) as seen:
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert seen.value.args == (300, 16, {})
