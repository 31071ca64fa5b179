"""The window features of stage 4: time, frequency, modes, wavelets, early signs and physics, joined into one row per window.

A recording is one row of arrays: source (preprocessed), clean (denoised), layers (modes, residual last), gates (a number per mode), rpm and
tooth_count. Windows are slices of these arrays, so nothing is shuffled until features are joined by (recording_id, window_index).
A feature without a defined value is NULL: no energy or spread, metadata missing, or too few samples.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.functions import kernels as K
from tremor.functions.expressions import distance_to_band, gaussian, kurtosis_pearson, near_harmonic, near_sideband, ratio
from tremor.operators import spectral as P
from tremor.operators import wavelets as B
from tremor.operators import windows as W
from tremor.operators.spectral import map_arrays

KEY = ["recording_id", "window_index"]
_D = T.DoubleType()
_LAYER = ("energy", "kurtosis", "correlation", "centre_hz", "bandwidth_hz", "entropy", "dominant_hz", "chatter_ratio", "forced_ratio")


def window_rows(recordings: DataFrame, length: int, hop: int) -> DataFrame:
    """The rows of recordings once for every full window, with the arrays cut to it."""
    if length < 2 or hop < 1:
        raise ValueError("a window needs at least two samples and a positive hop")
    last = F.floor((F.size("clean") - length) / hop).cast("int")
    rows = recordings.filter(F.size("clean") >= length).withColumn("window_index", F.explode(F.sequence(F.lit(0), last)))
    cut = lambda x: F.slice(x, F.col("window_index") * hop + 1, F.lit(length))
    return rows.withColumns({"source": cut(F.col("source")), "clean": cut(F.col("clean")), "layers": F.transform("layers", cut)})


def valid_metadata() -> Column:
    """Whether rpm is positive and finite and tooth_count a positive whole number."""
    rpm, teeth = F.col("rpm").cast("double"), F.col("tooth_count").cast("double")
    return F.coalesce((rpm > 0) & ~F.isnan(rpm) & (rpm < float("inf")) & (teeth >= 1) & (teeth == F.floor(teeth)), F.lit(False))


def correlation_of(a: np.ndarray, b: np.ndarray) -> float | None:
    """Absolute correlation of two centred arrays; None where one is constant."""
    size = float(np.sqrt((a @ a) * (b @ b)))
    return abs(float(a @ b)) / size if size > 0 else None


def _kurtosis(centred: np.ndarray) -> list[float | None]:
    """Of each centred row."""
    n, squares = centred.shape[1], centred * centred
    spread, fourth = squares.mean(1).tolist(), (squares * squares).mean(1).tolist()
    if n < 4:
        return [None] * len(spread)
    return [None if s <= 2.220446049250313e-16**2 else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (f / s**2 - 3) + 6) + 3 for s, f in zip(spread, fourth, strict=True)]


def _correlations(products: np.ndarray, a: np.ndarray, b) -> list[float | None]:
    """Absolute correlations from sums of products and of squares; None where one side is constant."""
    return [abs(p) / s if s > 0 else None for p, s in zip(products.tolist(), np.sqrt(a * b).tolist(), strict=True)]


def layer_metrics(rows: DataFrame, fs: float, chatter: tuple[float, float], harmonics: int, tolerance: float, nperseg: int = 1024) -> DataFrame:
    """rows without their arrays, with metrics: one struct per mode; and adjacent_mean, adjacent_max and orthogonality over the layers, spectral_overlap of neighbouring modes."""
    spindle = F.when(valid_metadata(), F.col("rpm") / 60.0)
    head = F.array(F.size("layers").cast("double"), spindle, spindle * F.col("tooth_count"))
    kept = [c for c in rows.columns if c not in ("source", "clean", "layers")]
    packed = rows.select(*kept, F.concat(head, "source", F.flatten("layers")).alias("x"))
    fields = [T.StructField("metrics", T.ArrayType(T.StructType([T.StructField(n, _D) for n in _LAYER]))), *(T.StructField(n, _D) for n in ("adjacent_mean", "adjacent_max", "orthogonality", "spectral_overlap"))]

    def kernel(v):
        m = v[3:].reshape(int(v[0]) + 1, -1)
        source, layers = m[0] - m[0].mean(), m[1:]
        freq = np.fft.rfftfreq(min(m.shape[1], nperseg), 1 / fs)
        inside = (freq >= chatter[0]) & (freq <= chatter[1])
        forced = np.zeros(len(freq), dtype=bool)
        for base in v[1:3][np.isfinite(v[1:3])]:
            forced |= (np.abs(freq[:, None] - base * np.arange(1, harmonics + 1)) <= tolerance).any(1)
        modes = layers[:-1]
        centred = modes - modes.mean(1, keepdims=True)
        squares = (centred * centred).sum(1)
        p = P.welch_rows(modes, fs, nperseg)
        total = p.sum(1)
        some = total > 0
        masses = np.divide(p, total[:, None], out=p.copy(), where=some[:, None])
        centre = masses @ freq
        log = np.log2(masses, out=np.zeros_like(masses), where=masses > 0)
        columns = [
            (modes * modes).sum(1).tolist(), _kurtosis(centred), _correlations(centred @ source, squares, source @ source), centre.tolist(), np.sqrt(((freq - centre[:, None]) ** 2 * masses).sum(1)).tolist(),
            *([v if ok else None for v, ok in zip(c.tolist(), some, strict=True)] for c in (-(masses * log).sum(1) / np.log2(len(freq)), freq[p.argmax(1)], masses[:, inside].sum(1), masses[:, forced].sum(1))),
        ]
        made = [dict(zip(_LAYER, values, strict=True)) for values in zip(*columns, strict=True)]
        near = [r for r in _correlations((centred[:-1] * centred[1:]).sum(1), squares[:-1], squares[1:]) if r is not None]
        overlaps = np.minimum(1.0, np.minimum(masses[:-1], masses[1:]).sum(1)) if len(masses) > 1 else []
        energy = float((layers * layers).sum())
        total = layers.sum(0)
        cross = (float(total @ total) - energy) / energy if energy > 0 else None
        return made, float(np.mean(near)) if near else None, max(near, default=None), cross, float(np.mean(overlaps)) if len(overlaps) else 0.0

    return map_arrays(packed, kernel, fields)


def falling_share(centre: Column) -> Column:
    """Share of neighbours in an array of centre frequencies that do not rise; NULL with fewer than two."""
    pairs = F.arrays_zip(F.slice(centre, 1, F.greatest(F.lit(0), F.size(centre) - 1)).alias("a"), F.slice(centre, 2, F.size(centre)).alias("b"))
    return F.when(F.size(centre) > 1, F.aggregate(pairs, F.lit(0.0), lambda s, z: s + (z["b"] <= z["a"]).cast("double")) / (F.size(centre) - 1))


def mode_features(metrics: DataFrame, selected: float = 0.5) -> DataFrame:
    """The imf_ features of each window."""
    part = lambda name: F.transform("metrics", lambda m: m[name])
    energy, total = part("energy"), F.aggregate(part("energy"), F.lit(0.0), lambda s, v: s + v)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(a), F.lit(0))
    centre = part("centre_hz")
    return metrics.select(
        *KEY,
        F.size("metrics").cast("double").alias("imf_count"),
        ratio(F.array_max(energy), total).alias("imf_max_energy_ratio"),
        F.try_element_at(part("correlation"), F.lit(1)).alias("imf1_correlation"),
        mean(centre).alias("imf_centre_freq_mean"),
        mean(part("bandwidth_hz")).alias("imf_bandwidth_mean"),
        mean(F.filter(part("entropy"), lambda v: v.isNotNull())).alias("imf_entropy_mean"),
        F.col("adjacent_mean").alias("imf_mode_mixing_index"),
        F.col("adjacent_max").alias("imf_max_adjacent_correlation"),
        F.col("orthogonality").alias("imf_orthogonality_index"),
        falling_share(centre).alias("imf_frequency_ordering_score"),
        F.when(F.col("gates").isNotNull(), F.size(F.filter("gates", lambda g: g >= selected)).cast("double")).alias("imf_selected_count"),
    )


def spectral_features(rows: DataFrame, fs: float, chatter: tuple[float, float], harmonics: int, tolerance: float, side_tolerance: float, nperseg: int = 1024) -> DataFrame:
    """The freq_ and physics_ features of each window's clean signal, and the energy ratios of the bands below, in and above the chatter band."""
    spindle = F.when(valid_metadata(), F.col("rpm") / 60.0)
    lean = rows.select(*KEY, spindle.alias("spindle"), (spindle * F.col("tooth_count")).alias("tooth"), F.col("clean").alias("x"))
    spectrum = P.psd(lean, fs, nperseg)
    f, p = F.col("freq"), F.col("p")
    spin, teeth = (near_harmonic(f, F.col(c), harmonics, tolerance) for c in ("spindle", "tooth"))
    bands = {
        "chatter": f.between(*chatter), "below": f.between(0.0, chatter[0]), "above": f.between(chatter[1], fs / 2),
        "spin": spin, "teeth": teeth, "forced": spin | teeth, "side": near_sideband(f, F.col("tooth"), F.col("spindle"), harmonics, side_tolerance),
    }
    sums = [F.sum(F.when(c, p).otherwise(0.0)).alias(f"__{n}") for n, c in bands.items()]
    made = spectrum.groupBy(*KEY, "spindle", "tooth").agg(*sums, F.sum("p").alias("__total"), (F.max("freq") / (F.count("*") - 1)).alias("__df"), kurtosis_pearson(p * 1000).alias("freq_spectral_kurtosis"))
    made = made.join(P.summary(spectrum, KEY).drop("total"), KEY)
    known, total, some = F.col("spindle").isNotNull(), F.col("__total"), F.col("__total") > 0
    share = lambda name, when=some: F.when(when, F.col(f"__{name}") / F.nullif(total, F.lit(0.0)))
    power = lambda name: F.col(f"__{name}") * F.col("__df")
    peak, half = F.when(some, F.col("peak")), (chatter[1] - chatter[0]) / 2
    distance = lambda base: F.array_min(F.transform(F.sequence(F.lit(1), F.lit(harmonics)), lambda k: F.abs(peak - k * F.col(base))))
    return made.select(
        *KEY,
        *(F.when(some, F.col(c)).alias(f"freq_{c}") for c in ("centroid", "spread", "entropy", "peak")),
        share("chatter").alias("freq_chatter_band_ratio"),
        F.when(some, F.col("freq_spectral_kurtosis")).alias("freq_spectral_kurtosis"),
        share("spin", known & some).alias("freq_spindle_harmonic_ratio"),
        share("teeth", known & some).alias("freq_tooth_harmonic_ratio"),
        share("teeth", known & some).alias("freq_harmonics_ratio"),
        F.when(known, ratio(F.col("__side"), F.col("__teeth"))).alias("freq_sideband_ratio"),
        *(share(b).alias(f"freq_band_energy_ratio_{n}") for b, n in (("below", "below_chatter"), ("chatter", "chatter"), ("above", "above_chatter"))),
        power("chatter").alias("physics_chatter_band_energy"),
        gaussian(distance_to_band(peak, *chatter), 0.0, half).alias("physics_frequency_proximity"),
        F.col("spindle").alias("physics_spindle_frequency_hz"),
        F.col("tooth").alias("physics_tooth_passing_frequency_hz"),
        distance("spindle").alias("physics_peak_to_spindle_harmonic_distance_hz"),
        distance("tooth").alias("physics_peak_to_tooth_harmonic_distance_hz"),
        F.when(known, power("side")).alias("physics_sideband_strength"),
        F.when(known, power("forced")).alias("physics_forced_vibration_energy"),
        F.when(known, ratio(F.col("__chatter"), F.col("__forced"))).alias("physics_chatter_to_harmonic_energy_ratio"),
    )


def wavelet_features(rows: DataFrame, wavelet: str, level: int) -> tuple[DataFrame, DataFrame]:
    """wavelet_high_freq_ratio and wavelet_entropy of each window, and the energies of the bands they come from."""
    e = B.energies(B.coefficients(rows.select(*KEY, F.col("clean").alias("x")), wavelet, level), KEY)
    q = F.col("energy_ratio")
    top = e.groupBy(*KEY).agg(
        F.when(F.max("level") > 0, F.sum(F.when(F.col("band").startswith("cD") & (F.col("level") <= 2), q).otherwise(0.0))).alias("wavelet_high_freq_ratio"),
        F.when(F.max("level") > 0, ratio(-F.sum(F.when(q > 0, q * F.log2(q))), F.log2(F.count("*").cast("double")))).alias("wavelet_entropy"),
    )
    return top, e


def _slope(t: np.ndarray, v: np.ndarray) -> float | None:
    t = t - t.mean()
    return float(t @ (v - v.mean()) / (t @ t)) if len(t) > 1 and t @ t > 0 else None


EARLY = (
    "wavelet_time_frequency_concentration", "wavelet_dominant_ridge_hz", "early_instantaneous_amplitude_mean", "early_instantaneous_amplitude_max", "early_instantaneous_energy_mean",
    "early_instantaneous_energy_max", "early_energy_growth_rate", "early_hegr", "early_chatter_band_energy_growth", "early_short_term_spectral_energy_growth",
)


def early_features(rows: DataFrame, fs: float, chatter: tuple[float, float], smooth_s: float = 0.01) -> DataFrame:
    """Short-time and envelope features of each window's clean signal."""

    def kernel(x):
        t, freq, e = K.short_time_energy(x, fs)
        total, frames = float(e.sum()), e.sum(1)
        a = K.envelope(x)
        length = min(len(x), max(3, round(smooth_s * fs)))
        smooth = np.convolve(a * a, np.ones(length) / length, mode="same")
        inside = (freq >= chatter[0]) & (freq <= chatter[1])
        ridge = (float(e.max()) / total, float(np.median(freq[e.argmax(1)]))) if total > 0 and len(frames) else (None, None)
        envelope = float(a.mean()), float(a.max()), float((a * a).mean()), float((a * a).max())
        return (*ridge, *envelope, _slope(np.arange(len(x)) / fs, smooth), K.energy_growth(x, fs, smooth_s), _slope(t, e[:, inside].sum(1)), _slope(t, frames))

    return map_arrays(rows.select(*KEY, F.col("clean").alias("x")), kernel, [T.StructField(n, _D) for n in EARLY])


def stage4_features(
    windows: DataFrame, fs: float, chatter: tuple[float, float], harmonics: int = 5, tolerance: float = 15.0, side_tolerance: float = 10.0, wavelet: str = "db8", level: int = 4, nperseg: int = 1024
) -> DataFrame:
    """The 54 static features, and the three band energy ratios, of every window of window_rows."""
    rows = windows.select(*KEY, F.posexplode("clean").alias("n", "x"))
    modes = mode_features(layer_metrics(windows, fs, chatter, harmonics, tolerance, nperseg))
    spectral = spectral_features(windows, fs, chatter, harmonics, tolerance, side_tolerance, nperseg)
    return W.time_features(rows).join(spectral, KEY).join(modes, KEY).join(wavelet_features(windows, wavelet, level)[0], KEY).join(early_features(windows, fs, chatter), KEY)


def dynamic_features(windows: DataFrame, fs: float, chatter: tuple[float, float], harmonics: int = 5, tolerance: float = 15.0, wavelet: str = "db8", level: int = 4, nperseg: int = 1024) -> DataFrame:
    """The features whose number depends on modes and wavelet bands, as rows (recording_id, window_index, feature, value)."""
    metrics = layer_metrics(windows, fs, chatter, harmonics, tolerance, nperseg)
    total = F.aggregate("metrics", F.lit(0.0), lambda s, m: s + m["energy"])
    named = {"centre_frequency_hz": "centre_hz", "bandwidth_hz": "bandwidth_hz", "spectral_entropy": "entropy", "kurtosis": "kurtosis", "source_correlation": "correlation"}

    def of_mode(m, i):
        alive = m["entropy"].isNotNull()
        values = {"energy_ratio": ratio(m["energy"], total), **{n: m[c] if n in ("kurtosis", "source_correlation") else F.when(alive, m[c]) for n, c in named.items()}, "gate": F.get(F.col("gates"), i)}
        return F.array(*(F.struct(F.concat(F.lit("imf_"), (i + 1).cast("string"), F.lit(f"_{n}")).alias("feature"), v.alias("value")) for n, v in values.items()))

    modes = metrics.select(*KEY, F.explode(F.flatten(F.transform("metrics", of_mode))).alias("z")).select(*KEY, "z.feature", "z.value")
    _, e = wavelet_features(windows, wavelet, level)
    band = F.regexp_replace("band", "^(c[AD])", "$1_")
    pairs = F.array(*(F.struct(F.concat(F.lit("wavelet_"), band, F.lit(f"_{n}")).alias("feature"), F.col(n).alias("value")) for n in ("energy", "energy_ratio")))
    return modes.union(e.filter("level > 0").select(*KEY, F.explode(pairs).alias("z")).select(*KEY, "z.feature", "z.value"))
