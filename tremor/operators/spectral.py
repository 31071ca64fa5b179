"""Spectra: Welch densities of array recordings in numpy batches, then spectral features as relations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tremor.functions.expressions import ratio


#: Samples whose rows a kernel's results are held for before they go on to Spark.
PIECE = 100_000


def map_arrays(arrays: DataFrame, kernel, fields: list, column: str = "x") -> DataFrame:
    """arrays with further columns from kernel(one array) -> tuple of values; an array that is NULL or empty gives NULLs."""
    return map_many(arrays, lambda values: [kernel(v) for v in values], fields, column)


def map_many(arrays: DataFrame, kernel, fields: list, column: str = "x") -> DataFrame:
    """The same with kernel(list of arrays) -> list of tuples, for work that is cheaper on many arrays at once."""
    kept = [f for f in arrays.schema.fields if f.name != column]
    schema = T.StructType([*kept, *fields])
    arrow = to_arrow_schema(schema)
    at = arrays.columns.index(column)
    rest = [(i, arrow.field(c).type) for i, c in enumerate(arrays.columns) if c != column]
    types = [arrow.field(f.name).type for f in fields]

    def run(batches):
        for batch in batches:
            values = list_values(batch.column(at))
            step = max(1, PIECE * len(values) // max(1, sum(map(len, values))))
            for start in range(0, len(values), step):
                part = batch.slice(start, step)
                some = [v for v in values[start : start + step] if len(v)]
                made = iter(kernel(some))
                rows = [next(made) if len(v) else (None,) * len(types) for v in values[start : start + step]]
                new = [pa.array([r[k] for r in rows], type=kind) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*(part.column(i).cast(kind) for i, kind in rest), *new], schema=arrow)

    return arrays.mapInArrow(run, schema)


def list_values(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column as views of its one buffer of values; a NULL array is empty, a NULL in one is NaN."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    ends = column.offsets.to_numpy()
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[lo:hi] if ok else values[:0] for lo, hi, ok in zip(ends[:-1], ends[1:], known, strict=True)]


def welch(x: np.ndarray, fs: float, nperseg: int) -> np.ndarray:
    """One-sided density: periodic Hann window, half overlap, mean removed from each segment."""
    return welch_rows(x[None], fs, nperseg)[0]


def welch_rows(x: np.ndarray, fs: float, nperseg: int) -> np.ndarray:
    """The density of each row."""
    n = min(x.shape[1], nperseg)
    step = n - n // 2
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    segments = np.lib.stride_tricks.sliding_window_view(x, n, axis=1)[:, ::step]
    power = np.abs(np.fft.rfft((segments - segments.mean(2, keepdims=True)) * w, axis=2)) ** 2 / (fs * (w * w).sum())
    power[:, :, 1 : -1 if n % 2 == 0 else None] *= 2
    return power.mean(1)


def psd(arrays: DataFrame, fs: float, nperseg: int = 1024, column: str = "x") -> DataFrame:
    """(.., k, freq, p) rows of the Welch density of each array."""
    field = T.StructField("psd", T.StructType([T.StructField("f", T.ArrayType(T.DoubleType())), T.StructField("p", T.ArrayType(T.DoubleType()))]))

    def kernel(x):
        p = welch(x, fs, nperseg)
        return ({"f": np.fft.rfftfreq(min(len(x), nperseg), 1 / fs), "p": p},)

    made = map_arrays(arrays, kernel, [field], column)
    keys = [c for c in made.columns if c != "psd"]
    return made.select(*keys, F.posexplode(F.arrays_zip(F.col("psd.f").alias("f"), F.col("psd.p").alias("p"))).alias("k", "z")).select(*keys, "k", F.col("z.f").alias("freq"), F.col("z.p").alias("p"))


def unit_mass(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    return spectrum.withColumn("p", ratio(F.col("p"), F.sum("p").over(Window.partitionBy(*keys))))


def summary(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """Centroid, spread, entropy over bins, peak, and total."""
    w = Window.partitionBy(*keys)
    share = spectrum.withColumn("__q", ratio(F.col("p"), F.sum("p").over(w))).withColumn("__c", F.sum(F.col("freq") * F.col("__q")).over(w))
    q, f = F.col("__q"), F.col("freq")
    return share.groupBy(*keys).agg(
        F.first("__c").alias("centroid"),
        F.sqrt(F.sum(F.pow(f - F.col("__c"), 2) * q)).alias("spread"),
        ratio(-F.sum(F.when(q > 0, q * F.log2(q))), F.log2(F.count("*").cast("double"))).alias("entropy"),
        F.max_by("freq", F.struct("p", -F.col("freq"))).alias("peak"),
        F.sum("p").alias("total"),
    )


def band_ratio(condition):
    """Share of the total in the bins where a condition holds."""
    return ratio(F.sum(F.when(condition, F.col("p")).otherwise(0.0)), F.sum("p"))


def overlap(spectrum: DataFrame, key: str, layer: str) -> DataFrame:
    """Sum over bins of the smaller of neighbouring layers' unit-mass densities, clipped to 1."""
    mass = unit_mass(spectrum, [key, layer])
    nxt = F.lead("p").over(Window.partitionBy(key, "k").orderBy(layer))
    return mass.withColumn("__next", nxt).filter("__next IS NOT NULL").groupBy(key, layer).agg(F.least(F.lit(1.0), F.sum(F.least("p", "__next"))).alias("overlap"))
