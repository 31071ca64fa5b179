"""Wavelet bands of array recordings as rows, their noise levels, thresholds and energies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.functions import kernels as K
from tremor.functions.expressions import overlap_fraction, ratio
from tremor.operators.spectral import map_arrays

_BANDS = T.ArrayType(T.StructType([T.StructField("band", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("c", T.ArrayType(T.DoubleType()))]))


def coefficients(arrays: DataFrame, wavelet: str, level: int) -> DataFrame:
    """(.., band, level, c): one row per band, coefficients as an array."""
    made = map_arrays(arrays, lambda x: ([{"band": b, "level": j, "c": c} for b, j, c in K.dwt(x, wavelet, level)],), [T.StructField("bands", _BANDS)])
    keys = [c for c in made.columns if c != "bands"]
    return made.select(*keys, F.explode("bands").alias("b")).select(*keys, "b.band", "b.level", "b.c")


def energies(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Energy of each band and its share of all bands."""
    e = bands.withColumn("energy", F.aggregate("c", F.lit(0.0), lambda s, v: s + v * v))
    return e.select(*keys, "band", "level", F.size("c").alias("count"), "energy", ratio(F.col("energy"), F.sum("energy").over(Window.partitionBy(*keys))).alias("energy_ratio"))


def _middle(values):
    """The median of an array column."""
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def noise_sigma(bands: DataFrame, keys: list[str], least: float = 1e-12) -> DataFrame:
    """Median absolute deviation of the finest details over 0.6745, array by array."""
    fine = bands.filter("band = 'cD1'").select(*keys, "c", _middle(F.col("c")).alias("m"))
    return fine.select(*keys, F.greatest(F.lit(least), _middle(F.transform("c", lambda d: F.abs(d - F.col("m")))) / 0.6745).alias("sigma"))


def thresholds(bands: DataFrame, keys: list[str], fs: float, band: tuple[float, float]) -> DataFrame:
    """Each detail band's frequency range, overlap with the chatter band, base threshold, scale and final threshold."""
    mean_square = F.aggregate("c", F.lit(0.0), lambda s, v: s + v * v) / F.size("c")
    largest = F.array_max(F.transform("c", lambda v: F.abs(v)))
    rows = bands.filter("band LIKE 'cD%'").join(noise_sigma(bands, keys), keys)
    signal = F.sqrt(F.greatest(F.lit(0.0), mean_square - F.col("sigma") * F.col("sigma")))
    base = F.when(signal > 2.220446049250313e-16, F.col("sigma") * F.col("sigma") / F.nullif(signal, F.lit(0.0))).otherwise(largest)
    low, high = fs * F.pow(F.lit(2.0), -(F.col("level") + 1)), fs * F.pow(F.lit(2.0), -F.col("level"))
    made = rows.withColumns({"low_hz": low, "high_hz": high, "base_threshold": base}).withColumn("overlap", overlap_fraction(F.col("low_hz"), F.col("high_hz"), *band))
    made = made.withColumn("scale", 0.5 * F.col("overlap") + 1.4 * (1 - F.col("overlap")))
    return made.withColumn("threshold", F.col("base_threshold") * F.col("scale"))


def threshold_energies(bands: DataFrame, keys: list[str], fs: float, band: tuple[float, float]) -> DataFrame:
    """Each band's energy before and after soft thresholding and their ratio (NULL without energy); the approximation passes as it is."""
    cut = thresholds(bands, keys, fs, band).select(*keys, "band", "threshold")
    both = bands.join(cut, [*keys, "band"], "left")
    energy = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    kept = F.when(F.col("threshold").isNull(), F.col("c")).otherwise(soft_threshold(F.col("c"), F.col("threshold")))
    made = both.select(*keys, "band", energy("c").alias("energy_before"), energy(kept).alias("energy_after"))
    return made.withColumn("energy_ratio", ratio(F.col("energy_after"), F.col("energy_before")))


def soft_threshold(values, threshold):
    """sign(v) * max(|v| - t, 0) for an array column."""
    return F.transform(values, lambda v: F.signum(v) * F.greatest(F.abs(v) - threshold, F.lit(0.0)))


def denoise(arrays: DataFrame, wavelet: str, level: int, fs: float, band: tuple[float, float] | None) -> DataFrame:
    return map_arrays(arrays, lambda x: (K.wavelet_denoise(x, wavelet, level, fs, band),), [T.StructField("x", T.ArrayType(T.DoubleType()))])
