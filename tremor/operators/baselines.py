"""Denoising baselines against the whole chain, on recordings with a known clean part: a grid of recording x noise x method, its cells independent of each other."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.functions import kernels as K
from tremor.operators import decompose as C
from tremor.operators import search as R
from tremor.operators import stage4 as S4
from tremor.operators.spectral import map_arrays
from tremor.operators.tables import keep

_DS = T.ArrayType(T.DoubleType())
METHODS = ("raw", "butterworth_only", "wavelet_only", "stft_baseline", "ceemdan_only", "ceemdan_simple_selection", "current_maiw", "full_proposed")


def frames_of(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Half-overlapping spectra of x with half a frame of zeros before and after it, and the window (a periodic Hann one)."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)
    step = width - width // 2
    y = np.concatenate([np.zeros(width // 2), x, np.zeros(width // 2)])
    y = np.concatenate([y, np.zeros(-(len(y) - width) % step)])
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(y, width)[::step] * w, axis=1) / w.sum(), w


def overlap_add(z: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """The n samples whose frames come closest to z in squares: windowed inverse frames are summed and divided by the summed squares of the window."""
    width = len(w)
    step = width - width // 2
    frames = np.fft.irfft(z * w.sum(), n=width, axis=1) * w
    y, norm = np.zeros((len(z) - 1) * step + width), np.zeros((len(z) - 1) * step + width)
    at = (np.arange(len(z)) * step)[:, None] + np.arange(width)
    np.add.at(y, at, frames)
    np.add.at(norm, at, np.broadcast_to(w * w, at.shape))
    y = np.divide(y, norm, out=np.zeros_like(y), where=norm > 1e-10)[width // 2 :]
    return y[:n] if len(y) >= n else np.pad(y, (0, n - len(y)))


def spectral_threshold(x: np.ndarray) -> np.ndarray:
    """Short-time spectra without the bins under the universal threshold, but at most the largest magnitude (0.6745, frames of 32 to 256 samples: fixed values)."""
    width = min(256, max(32, len(x) // 4), len(x))
    z, w = frames_of(x, width)
    size = np.abs(z)
    bound = min(float(np.median(size)) / 0.6745 * np.sqrt(2 * np.log(size.size)), float(size.max()))
    return overlap_add(np.where(size > bound, z, 0), w, len(x))


def selected_modes(layers: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    """Sum of the modes whose strongest frequency lies in the band, of all modes where none does; the residual is never in it."""
    modes = layers[:-1]
    if not len(modes):
        return np.zeros(layers.shape[1])
    strongest = np.fft.rfftfreq(layers.shape[1], 1 / fs)[np.abs(np.fft.rfft(modes, axis=1)).argmax(1)]
    inside = (strongest >= low) & (strongest <= high)
    return modes[inside if inside.any() else slice(None)].sum(0)


def mixed_weights(metrics, chatter: tuple[float, float]):
    """Mode weights that sum to 1, as an array: equal parts of the shares of correlation, energy, kurtosis and the strongest bin's proximity to the band."""
    centre, half = (chatter[0] + chatter[1]) / 2, (chatter[1] - chatter[0]) / 2
    gap = lambda m: (m["dominant_hz"] - centre) / half
    finite = lambda c: F.when(F.abs(c) < float("inf"), c).otherwise(0.0)  # noqa: E731  null and NaN count as 0
    each = lambda f: F.transform(metrics, lambda m: finite(f(m)))
    parts = [each(f) for f in (lambda m: F.abs(m["correlation"]), lambda m: m["energy"], lambda m: m["kurtosis"], lambda m: F.exp(-gap(m) * gap(m) / 2))]

    def shares(values):
        total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
        return F.transform(values, lambda v: F.when(total > 0, v / total).otherwise(F.lit(1.0) / F.size(values)))

    mixed = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [shares(p) for p in parts])
    whole = F.aggregate(mixed, F.lit(0.0), lambda s, v: s + v)
    return F.transform(mixed, lambda v: v / whole)


def denoised(cells: DataFrame, fs: float, band: tuple[float, float], chatter: tuple[float, float], wavelet: str, level: int, baseline: tuple[str, int], trials: int, sifts: int, order: int = 4) -> DataFrame:
    """(recording_id, noise, reference, method, clean) from cells (recording_id, noise, x, reference); rpm and tooth_count are used where they are there."""
    keys = ["recording_id", "noise"]

    def plain(x):
        filtered = K.detrend(K.bandpass(x, *band, fs, order))
        return x, filtered, K.wavelet_denoise(filtered, *baseline, fs, chatter), spectral_threshold(x)

    doubles = [T.StructField(m, _DS) for m in METHODS[:4]]
    first = map_arrays(R.spread(cells.select(*keys, "x"), *keys), plain, doubles)
    layered = keep(R.decompose(cells.select(*keys, F.col("x").alias("source"), *(c for c in ("rpm", "tooth_count") if c in cells.columns)), keys, trials, sifts), "layers")
    known = layered.withColumns({c: F.lit(None).cast("double") for c in ("rpm", "tooth_count") if c not in layered.columns})
    weights = S4.layer_metrics(known, fs, chatter, 5, 15.0).select(*keys, mixed_weights(F.col("metrics"), chatter).alias("weights"))
    packed = layered.join(weights, keys).select(*keys, F.concat(F.array(F.size("layers").cast("double")), "weights", F.flatten("layers")).alias("x"))

    def modes(v):
        k = int(v[0])
        layers = v[k:].reshape(k, -1)  # behind the number of layers and a weight for each mode
        return layers.sum(0), selected_modes(layers, fs, *band), v[1:k] @ layers[:-1]

    second = map_arrays(packed, modes, [T.StructField(m, _DS) for m in METHODS[4:7]])
    name = F.concat_ws("|", F.col("recording_id").cast("string"), F.col("noise").cast("string"))
    named = cells.withColumn("__cell", name)
    chain = named.drop("recording_id").withColumnRenamed("__cell", "recording_id").drop("noise", "reference")
    whole = C.gated_recordings(chain, *band, fs, chatter, 5, 15.0, wavelet, level, trials=trials).select(F.col("recording_id").alias("__cell"), F.col("clean").alias(METHODS[7]))
    joined = named.select(*keys, "reference", "__cell").join(first, keys).join(second, keys).join(whole, "__cell").drop("__cell")
    tried = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("clean")) for m in METHODS])).alias("s")
    return joined.select(*keys, "reference", tried).select(*keys, "reference", "s.*")


def benchmark(recordings: DataFrame, noises: list[float], fs: float, band: tuple[float, float], chatter: tuple[float, float], wavelet: str = "db8", level: int = 4, baseline: tuple[str, int] = ("db4", 3), trials: int = 2, sifts: int = 2, onset_s: float | None = None, seed: int = 0) -> DataFrame:
    """(noise, method, recordings, mean of each QUALITY) for rows (recording_id, reference): white noise of each relative deviation is added, and every method removes it.

    Means leave out what is not defined (an onset that is not found) and infinite ratios.
    """
    grid = recordings.withColumn("noise", F.explode(F.array(*map(F.lit, noises))))
    # two hashes of (recording, noise, sample, seed) make a normal deviate, whatever the partitions
    unit = lambda i, k: (F.pmod(F.xxhash64("recording_id", "noise", i, F.lit(seed), F.lit(k)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    spread_ = F.sqrt(F.aggregate("reference", F.lit(0.0), lambda s, v: s + v * v) / F.size("reference"))
    x = F.transform("reference", lambda v, i: v + F.col("noise") * spread_ * F.sqrt(-2 * F.log(unit(i, 1))) * F.cos(2 * np.pi * unit(i, 2)))
    cells = keep(grid.withColumn("x", x), "cells")
    rated = R.reference_quality(denoised(cells, fs, band, chatter, wavelet, level, baseline, trials, sifts), fs, chatter, onset_s)
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    return rated.groupBy("noise", "method").agg(F.count("*").alias("recordings"), *[F.avg(finite(c)).alias(c) for c in R.QUALITY])
