"""Modes (layers of a decomposition): metrics, relevance gates, weights and reconstruction, as relations.

Modes are rows (recording_id, layer, is_residual, n, x); the residual is flagged, never guessed by its place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.functions.expressions import clip, correlation, finite, gaussian, kurtosis_pearson, near_harmonic, ratio, sigmoid
from tremor.operators import spectral

#: Weights of the gate's score (fixed values of the method), and of the four indicator shares.
GATE = {"chatter": 4.0, "correlation": 2.0, "kurtosis": 1.0, "proximity": 1.0, "forced": -5.0, "offset": -1.5}


def moving_average_modes(signal: DataFrame, widths: tuple[int, ...] = (3, 9, 27)) -> DataFrame:
    """A deterministic split: differences of moving averages of growing width, and the last average as residual."""
    w = Window.partitionBy("recording_id").orderBy("n")
    levels = [F.col("x")] + [F.avg("x").over(w.rowsBetween(-(k // 2), k // 2)) for k in widths]
    named = signal.select("recording_id", "n", *[level.alias(f"__a{i}") for i, level in enumerate(levels)])
    layers = [F.struct(F.lit(i + 1).alias("layer"), F.lit(False).alias("is_residual"), (F.col(f"__a{i}") - F.col(f"__a{i + 1}")).alias("x")) for i in range(len(widths))]
    layers.append(F.struct(F.lit(len(widths) + 1).alias("layer"), F.lit(True).alias("is_residual"), F.col(f"__a{len(widths)}").alias("x")))
    return named.select("recording_id", "n", F.explode(F.array(*layers)).alias("s")).select("recording_id", "s.layer", "s.is_residual", "n", "s.x")


def mode_arrays(modes: DataFrame, residual: bool = False) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("n", "x")))
    return (modes if residual else modes.filter("NOT is_residual")).groupBy("recording_id", "layer").agg(F.transform(pairs, lambda s: s["x"]).alias("x"))


def mode_psd(modes: DataFrame, fs: float, nperseg: int = 1024) -> DataFrame:
    return spectral.psd(mode_arrays(modes), fs, nperseg)


def mode_metrics(modes: DataFrame, spectrum: DataFrame) -> DataFrame:
    """Energy in percent of all physical modes, RMS, centre, bandwidth and entropy of each."""
    physical = modes.filter("NOT is_residual")
    energy = physical.groupBy("recording_id", "layer").agg(F.sum(F.col("x") * F.col("x")).alias("__e"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    share = energy.withColumn("energy_percentage", 100 * ratio(F.col("__e"), F.sum("__e").over(Window.partitionBy("recording_id")))).drop("__e")
    s = spectral.summary(spectrum, ["recording_id", "layer"]).select("recording_id", "layer", F.col("centroid").alias("centre_hz"), F.col("spread").alias("bandwidth_hz"), F.col("entropy").alias("spectral_entropy"))
    return share.join(s, ["recording_id", "layer"])


def adjacent_correlation(modes: DataFrame) -> DataFrame:
    """Absolute correlation of each physical mode with the next."""
    w = Window.partitionBy("recording_id", "n").orderBy("layer")
    pairs = modes.filter("NOT is_residual").withColumn("__next", F.lead("x").over(w)).filter("__next IS NOT NULL")
    return pairs.groupBy("recording_id", "layer").agg(F.coalesce(F.abs(correlation(F.col("x"), F.col("__next"))), F.lit(0.0)).alias("correlation"))


def correlation_matrix(modes: DataFrame) -> DataFrame:
    """Absolute correlations of all pairs of physical modes, i <= j: one matrix product per recording."""
    one = mode_arrays(modes).groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("layer", "x"))).alias("a"))
    packed = one.select("recording_id", F.concat(F.array(F.size("a").cast("double")), F.transform("a", lambda m: m["layer"].cast("double")), F.flatten(F.transform("a", lambda m: m["x"]))).alias("x"))
    pair = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("correlation", T.DoubleType())])

    def kernel(v):
        k = int(v[0])
        m = v[k + 1 :].reshape(k, -1)
        m = m - m.mean(1, keepdims=True)
        size = np.sqrt((m * m).sum(1))
        r = np.divide(np.abs(m @ m.T), np.outer(size, size), out=np.zeros((k, k)), where=np.outer(size, size) > 0)
        return ([{"i": int(v[1 + i]), "j": int(v[1 + j]), "correlation": float(r[i, j])} for i in range(k) for j in range(i, k)],)

    made = spectral.map_arrays(packed, kernel, [T.StructField("pairs", T.ArrayType(pair))])
    return made.select("recording_id", F.explode("pairs").alias("p")).select("recording_id", "p.*")


def orthogonality(modes: DataFrame) -> DataFrame:
    """Signed index over all layers: (|sum|^2 - sum of |.|^2) / sum of |.|^2, without a self-join."""
    total = modes.groupBy("recording_id", "n").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("e"))
    return total.groupBy("recording_id").agg(ratio(F.sum(F.col("s") * F.col("s")) - F.sum("e"), F.sum("e")).alias("orthogonality"))


def orthogonality_forms(modes: DataFrame) -> DataFrame:
    """Signed, absolute and pairwise absolute index over all layers, relative to their energy: one product of the layers with themselves per recording; NULL without energy."""
    one = mode_arrays(modes, residual=True).groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("layer", "x"))).alias("a"))
    packed = one.select("recording_id", F.concat(F.array(F.size("a").cast("double")), F.flatten(F.transform("a", lambda m: m["x"]))).alias("x"))
    names = ("signed", "absolute", "pairwise_absolute")

    def kernel(v):
        m = v[1:].reshape(int(v[0]), -1)
        g = m @ m.T
        energy, cross = float(np.trace(g)), g[np.triu_indices(len(g), 1)]
        return (2 * float(cross.sum()) / energy, abs(2 * float(cross.sum()) / energy), 2 * float(np.abs(cross).sum()) / energy) if energy > 0 else (None,) * 3

    return spectral.map_arrays(packed, kernel, [T.StructField(n, T.DoubleType()) for n in names])


def decomposition_validation(modes: DataFrame, fs: float) -> DataFrame:
    """Per recording, over all layers: orthogonality index, mean absolute correlation of neighbours, how far mean frequencies fall with the layer (1 falling, 0 rising; by correlation), and each layer's percentage of the energy.

    Mean frequencies weigh magnitudes below half the rate. One layer is in order and mixes with nothing; equal frequencies count as falling.
    """
    one = mode_arrays(modes, residual=True).groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("layer", "x"))).alias("a"))
    packed = one.select("recording_id", F.concat(F.array(F.size("a").cast("double")), F.flatten(F.transform("a", lambda m: m["x"]))).alias("x"))

    def kernel(v):
        m = v[1:].reshape(int(v[0]), -1)
        g = m @ m.T
        energy = float(np.trace(g))
        centred = m - m.mean(1, keepdims=True)
        size = np.sqrt((centred * centred).sum(1))
        near = [abs(float(a @ b / (p * q))) if p * q > 0 else 0.0 for a, b, p, q in zip(centred, centred[1:], size, size[1:], strict=False)]
        half = (m.shape[1] + 1) // 2
        spectrum = np.abs(np.fft.rfft(m, axis=1))[:, :half]
        total = spectrum.sum(1)
        mean = np.divide(spectrum @ (np.arange(half) * fs / m.shape[1]), total, out=np.zeros(len(m)), where=total > 0)
        falling = 1.0 if len(m) < 2 else (1 - float(np.corrcoef(np.arange(len(m)), mean)[0, 1])) / 2 if mean.std() > 0 else float((np.diff(mean) <= 0).all())
        return (float(g.sum()) - energy) / energy if energy > 0 else 0.0, float(np.mean(near)) if near else 0.0, falling, list(np.diag(g) / energy * 100) if energy > 0 else [0.0] * len(m)

    fields = [*(T.StructField(n, T.DoubleType()) for n in ("orthogonality_index", "mode_mixing_index", "frequency_ordering_index")), T.StructField("energy_percent", T.ArrayType(T.DoubleType()))]
    return spectral.map_arrays(packed, kernel, fields)


def frequency_ordering(metrics: DataFrame) -> DataFrame:
    """Share of neighbouring modes whose centre frequency does not rise; 1 with a single mode."""
    nxt = F.lead("centre_hz").over(Window.partitionBy("recording_id").orderBy("layer"))
    return metrics.withColumn("__next", nxt).groupBy("recording_id").agg(F.coalesce(F.avg(F.when(F.col("__next").isNotNull(), (F.col("centre_hz") >= F.col("__next")).cast("double"))), F.lit(1.0)).alias("ordering"))


def reconstruction_error(signal: DataFrame, modes: DataFrame) -> DataFrame:
    """RMS of signal minus the sum of its layers, over the RMS of the signal."""
    total = modes.groupBy("recording_id", "n").agg(F.sum("x").alias("s"))
    gap = F.col("x") - F.col("s")
    return signal.join(total, ["recording_id", "n"]).groupBy("recording_id").agg(ratio(F.sqrt(F.avg(gap * gap)), F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("nrmse"))


def indicators(signal: DataFrame, modes: DataFrame, spectrum: DataFrame, chatter: tuple[float, float], forced_hz: float, harmonics: int, tolerance: float, kurtosis_scale: float = 10.0) -> DataFrame:
    """Per physical mode: chatter and forced ratios, source correlation, kurtosis (also bounded), proximity of the centroid and of the strongest bin to the chatter band's centre, energy."""
    centre, half = (chatter[0] + chatter[1]) / 2, (chatter[1] - chatter[0]) / 2
    f = F.col("freq")
    w = Window.partitionBy("recording_id", "layer")
    bands = spectrum.withColumn("__c", ratio(F.sum(f * F.col("p")).over(w), F.sum("p").over(w))).groupBy("recording_id", "layer").agg(
        spectral.band_ratio(f.between(*chatter)).alias("chatter_ratio"),
        spectral.band_ratio(near_harmonic(f, F.lit(forced_hz), harmonics, tolerance)).alias("forced_ratio"),
        F.first("__c").alias("centre_hz"),
        F.max_by("freq", F.struct("p", -F.col("freq"))).alias("dominant_hz"),
    )
    physical = modes.filter("NOT is_residual")
    moments = physical.join(signal.withColumnRenamed("x", "source"), ["recording_id", "n"]).groupBy("recording_id", "layer").agg(
        F.coalesce(F.abs(correlation(F.col("x"), F.col("source"))), F.lit(0.0)).alias("correlation"),
        kurtosis_pearson(F.col("x")).alias("kurtosis"),
        F.sum(F.col("x") * F.col("x")).alias("energy"),
    )
    joined = bands.join(moments, ["recording_id", "layer"])
    return joined.withColumn("kurtosis_score", F.coalesce(clip((F.col("kurtosis") - 3.0) / kurtosis_scale, 0.0, 1.0), F.lit(0.0))).withColumns(
        {"proximity": gaussian(F.col("centre_hz"), centre, half), "dominant_proximity": gaussian(F.col("dominant_hz"), centre, half)}
    )


def gates(table: DataFrame) -> DataFrame:
    """indicators with gate: a sigmoid of their weighted sum."""
    score = (
        GATE["chatter"] * F.coalesce("chatter_ratio", F.lit(0.0)) + GATE["correlation"] * F.col("correlation") + GATE["kurtosis"] * F.col("kurtosis_score")
        + GATE["proximity"] * F.col("proximity") + GATE["forced"] * F.coalesce("forced_ratio", F.lit(0.0)) + GATE["offset"]
    )
    return table.withColumn("gate", sigmoid(score))


def gate_array(metrics, chatter: tuple[float, float], kurtosis_scale: float = 10.0):
    """The gates of an array of mode metrics (structs with chatter_ratio, forced_ratio, correlation, kurtosis and centre_hz), as an array."""
    centre, half = (chatter[0] + chatter[1]) / 2, (chatter[1] - chatter[0]) / 2
    zero = F.lit(0.0)

    def gate(m):
        bounded = F.coalesce(clip((m["kurtosis"] - 3.0) / kurtosis_scale, 0.0, 1.0), zero)
        parts = {"chatter": F.coalesce(m["chatter_ratio"], zero), "correlation": F.coalesce(m["correlation"], zero), "kurtosis": bounded, "proximity": gaussian(m["centre_hz"], centre, half), "forced": F.coalesce(m["forced_ratio"], zero)}
        return sigmoid(sum((GATE[k] * v for k, v in parts.items()), F.lit(GATE["offset"])))

    return F.transform(metrics, gate)


def shares(column: str):
    """An indicator over its sum in the recording; missing and infinite values count as 0, equal shares where the sum is not positive."""
    w = Window.partitionBy("recording_id")
    v = F.coalesce(finite(F.col(column)), F.lit(0.0))
    return F.when(F.sum(v).over(w) > 0, v / F.sum(v).over(w)).otherwise(1.0 / F.count("*").over(w))


def indicator_weights(table: DataFrame, mix: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """Weights that sum to 1: a mix of the shares of correlation, energy, kurtosis and the strongest bin's proximity."""
    raw = table.withColumns({f"__s{i}": shares(c) for i, c in enumerate(("correlation", "energy", "kurtosis", "dominant_proximity"))})
    raw = raw.withColumn("__w", sum((m * F.col(f"__s{i}") for i, m in enumerate(mix)), F.lit(0.0)))
    return raw.withColumn("weight", F.col("__w") / F.sum("__w").over(Window.partitionBy("recording_id"))).drop("__w", "__s0", "__s1", "__s2", "__s3")


def reconstruct(modes: DataFrame, weights: DataFrame, column: str) -> DataFrame:
    """Weighted sum of the physical modes."""
    w = weights.select("recording_id", "layer", F.col(column).alias("__w"))
    return modes.filter("NOT is_residual").join(w, ["recording_id", "layer"]).groupBy("recording_id", "n").agg(F.sum(F.col("x") * F.col("__w")).alias("x"))


def compare_spectra(before: DataFrame, after: DataFrame, chatter: tuple[float, float]) -> DataFrame:
    """Energy retention, out-of-band attenuation and L1 distortion between two spectra per recording."""
    both = before.select("recording_id", "k", "freq", F.col("p").alias("a")).join(after.select("recording_id", "k", F.col("p").alias("b")), ["recording_id", "k"])
    inside = F.col("freq").between(*chatter)
    w = Window.partitionBy("recording_id")
    both = both.withColumn("__l1", F.abs(ratio(F.col("a"), F.sum("a").over(w)) - ratio(F.col("b"), F.sum("b").over(w))))
    part = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0.0))
    return both.groupBy("recording_id").agg(
        F.coalesce(ratio(part("b", inside), part("a", inside)), F.lit(0.0)).alias("chatter_retention"),
        (1 - F.coalesce(ratio(part("b", ~inside), part("a", ~inside)), F.lit(0.0))).alias("out_of_band_attenuation"),
        F.coalesce(F.sum("__l1"), F.lit(0.0)).alias("spectral_distortion"),
    )


def gate_stability(gates_by_seed: DataFrame, threshold: float) -> DataFrame:
    """Mean and deviation of each mode's gate over seeds, how many seeds select it, and whether all agree; missing gates are left out."""
    chosen = F.when(F.col("gate").isNotNull(), (F.col("gate") >= threshold).cast("int"))
    return gates_by_seed.withColumn("__s", chosen).groupBy("recording_id", "layer").agg(
        F.avg("gate").alias("mean_gate"), F.stddev_pop("gate").alias("std_gate"), F.sum("__s").alias("selected"), (F.count_distinct("__s") == 1).alias("unanimous")
    )
