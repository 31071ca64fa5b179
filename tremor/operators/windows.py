"""Windows over signals: sliding windows, moving statistics, thresholds with memory, runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions.expressions import kurtosis_pearson, ratio, skewness_corrected



def per_recording():
    return Window.partitionBy("recording_id")


def in_order():
    return Window.partitionBy("recording_id").orderBy("n")


def sliding_windows(signal: DataFrame, length: int, hop: int) -> DataFrame:
    """Each sample once for every window [k * hop, k * hop + length) that holds it; a rest that fills no window is left out."""
    if length < 2 or hop < 1:
        raise ValueError("a window needs at least two samples and a positive hop")
    n, total = F.col("n"), F.count("*").over(per_recording())
    lo = F.greatest(F.lit(0), F.ceil((n - length + 1) / hop))
    hi = F.least(F.floor(n / hop), F.floor((total - length) / hop))
    return signal.withColumns({"__lo": lo, "__hi": hi}).filter("__lo <= __hi").withColumn("window_index", F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")


def hop_of(length: int, overlap: float) -> int:
    return max(1, round(length * (1 - overlap)))


def window_bounds(signal: DataFrame, length: int, hop: int, fs: float) -> DataFrame:
    """One row per window with its half-open bounds in samples and seconds."""
    sizes = signal.groupBy("recording_id").agg(F.count("*").alias("total")).filter(F.col("total") >= length)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - length) / hop)))
    rows = sizes.select("recording_id", k.alias("window_index"))
    start = F.col("window_index") * hop
    return rows.select("recording_id", "window_index", start.alias("start_index"), (start + length).alias("end_index"), (start / fs).alias("start_s"), ((start + length) / fs).alias("end_s"))


def whole_or_sliding(signal: DataFrame, seconds: float, overlap: float, fs: float) -> DataFrame:
    """Bounds by truncated lengths; a recording that fits no window is one window of its own."""
    length = int(seconds * fs)
    hop = max(1, int(length * (1 - overlap)))
    sizes = signal.groupBy("recording_id").agg(F.count("*").alias("total"))
    count = F.when(F.col("total") >= length, F.floor((F.col("total") - length) / hop)).otherwise(0)
    rows = sizes.withColumn("window_index", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long"))))
    start = F.col("window_index") * hop
    return rows.select("recording_id", "window_index", start.alias("start_index"), F.least(start + length, F.col("total")).alias("end_index"))


def even_windows(signal: DataFrame, count: int, length: int) -> DataFrame:
    """`count` windows of a length with evenly spaced, truncated starts; one window where the signal is no longer."""
    sizes = signal.groupBy("recording_id").agg(F.count("*").alias("total"))
    last = F.when(F.col("total") <= length, 0).otherwise(count - 1)
    rows = sizes.withColumn("window_index", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    start = F.when(F.col("total") <= length, 0).otherwise(F.floor(F.col("window_index") * (F.col("total") - length) / max(1, count - 1))).cast("long")
    return rows.select("recording_id", "window_index", start.alias("start_index"), F.least(start + length, F.col("total")).alias("end_index"))


def time_features(windowed: DataFrame) -> DataFrame:
    """The time-domain features of each window; ratios are NULL without a denominator."""
    x, a = F.col("x"), F.abs("x")
    crossed = windowed.withColumn("__neg", (x < 0).cast("int")).withColumn("__before", F.lag("__neg").over(Window.partitionBy("recording_id", "window_index").orderBy("n")))
    rms = F.sqrt(F.avg(x * x))
    return crossed.groupBy("recording_id", "window_index").agg(
        rms.alias("time_rms"),
        F.var_pop(x).alias("time_variance"),
        F.stddev_pop(x).alias("time_std"),
        (F.max(x) - F.min(x)).alias("time_peak_to_peak"),
        F.avg(a).alias("time_mean_absolute"),
        ratio(F.max(a), rms).alias("time_crest_factor"),
        kurtosis_pearson(x).alias("time_kurtosis"),
        skewness_corrected(x).alias("time_skewness"),
        ratio(F.max(a), F.avg(a)).alias("time_impulse_factor"),
        ratio(rms, F.avg(a)).alias("time_shape_factor"),
        ratio(F.max(a), F.pow(F.avg(F.sqrt(a)), 2)).alias("time_clearance_factor"),
        ratio(F.sum((F.col("__neg") != F.col("__before")).cast("double")), (F.count("*") - 1).cast("double")).alias("time_zero_crossing_rate"),
    )


def max_energy_segment(signal: DataFrame, points: int) -> DataFrame:
    """The first stretch of `points` samples with the most energy; the whole signal where it is no longer."""
    total = F.count("*").over(per_recording())
    rolled = signal.select("recording_id", "n", F.sum(F.col("x") * F.col("x")).over(in_order().rowsBetween(0, points - 1)).alias("energy"), total.alias("total"))
    starts = rolled.filter((F.col("n") <= F.col("total") - points) | ((F.col("total") <= points) & (F.col("n") == 0)))
    best = starts.groupBy("recording_id").agg(F.max_by(F.struct("n", "energy", "total"), F.struct(F.round("energy", 9), -F.col("n"))).alias("b"))
    return best.select("recording_id", F.col("b.n").alias("start_index"), F.least(F.col("b.n") + points, F.col("b.total")).alias("end_index"), F.col("b.energy").alias("energy"))


def moving_average(signal: DataFrame, length: int, value: str = "x", name: str = "smoothed") -> DataFrame:
    """Centred sum over a fixed length; outside the signal counts as zeros."""
    return signal.withColumn(name, F.sum(value).over(in_order().rowsBetween(-(length // 2), (length - 1) // 2)) / length)


def gradient(signal: DataFrame, dt: float, value: str = "x", name: str = "gradient") -> DataFrame:
    """Central differences inside, one-sided at the ends."""
    x, before, after = F.col(value), F.lag(value).over(in_order()), F.lead(value).over(in_order())
    return signal.withColumn(name, F.when(before.isNull(), (after - x) / dt).when(after.isNull(), (x - before) / dt).otherwise((after - before) / (2 * dt)))


def detrend_linear(signal: DataFrame) -> DataFrame:
    """x less its least-squares line over n."""
    line = signal.groupBy("recording_id").agg(F.regr_slope("x", F.col("n").cast("double")).alias("slope"), F.regr_intercept("x", F.col("n").cast("double")).alias("intercept"))
    return signal.join(line, "recording_id").withColumn("detrended", F.col("x") - (F.col("intercept") + F.col("slope") * F.col("n")))


def running_median(scores: DataFrame, width: int, value: str = "p", name: str = "smoothed") -> DataFrame:
    """Median of the values around each one; the first and last value stand in for those beyond the ends."""
    if width < 2:
        return scores.withColumn(name, F.col(value))
    before, after = width // 2, width - 1 - width // 2
    frame = F.collect_list(value).over(in_order().rowsBetween(-before, after))
    rank = F.row_number().over(in_order())
    left = F.greatest(F.lit(0), F.lit(before + 1) - rank)
    right = F.greatest(F.lit(0), rank + after - F.count("*").over(per_recording())).cast("int")
    full = F.concat(F.array_repeat(F.first(value).over(in_order()), left), frame, F.array_repeat(F.last(value).over(in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), right))
    sorted_ = F.array_sort(full)
    middle = (F.element_at(sorted_, (width + 1) // 2) + F.element_at(sorted_, width // 2 + 1)) / 2
    return scores.withColumn("__m", middle).withColumn(name, F.col("__m")).drop("__m")


def hysteresis(scores: DataFrame, enter: float, exit_: float, value: str = "smoothed", name: str = "state") -> DataFrame:
    """1 from the first value of at least `enter` until one under `exit_`."""
    if not 0 <= exit_ < enter <= 1:
        raise ValueError("0 <= exit < enter <= 1 is needed")
    mark = F.when(F.col(value) >= enter, 1).when(F.col(value) < exit_, 0)
    return scores.withColumn(name, F.coalesce(F.last(mark, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def minimum_run(scores: DataFrame, least: int, value: str = "state", name: str = "label") -> DataFrame:
    """Runs of 1 shorter than `least` become 0."""
    changed = scores.withColumn("__new", (F.col(value) != F.coalesce(F.lag(value).over(in_order()), F.lit(-1))).cast("int"))
    run = changed.withColumn("__run", F.sum("__new").over(in_order()))
    size = F.count("*").over(Window.partitionBy("recording_id", "__run"))
    return run.withColumn(name, F.when((F.col(value) == 1) & (size >= least), 1).otherwise(0)).drop("__new", "__run")


def smooth_labels(scores: DataFrame, enter: float = 0.75, exit_: float = 0.40, least: int = 3, width: int = 3) -> DataFrame:
    return minimum_run(hysteresis(running_median(scores, width), enter, exit_), least)


def onset(signal: DataFrame, width: int = 50) -> DataFrame:
    """Last sample before the distance from the mean first crosses half its range; NULL without a crossing. Signals longer than width are smoothed."""
    centred = signal.withColumn("__d", F.abs(F.col("x") - F.avg("x").over(per_recording())))
    smooth = moving_average(centred, width, "__d", "__s").withColumn("__s", F.when(F.count("*").over(per_recording()) > width, F.col("__s")).otherwise(F.col("__d")))
    ranged = smooth.withColumn("__half", (F.min("__s").over(per_recording()) + F.max("__s").over(per_recording())) / 2).withColumn("__on", (F.col("__s") > F.col("__half")).cast("int"))
    turned = ranged.withColumn("__next", F.lead("__on").over(in_order()))
    return turned.groupBy("recording_id").agg(F.min(F.when(F.col("__on") != F.col("__next"), F.col("n"))).alias("onset_index"))


def semisynthetic(signal: DataFrame, fs: float, tone_hz: float, onset_s: float, snr_db: float) -> DataFrame:
    """x plus a tone that sets in along a logistic curve, scaled so that var(x) / var(tone) is the given ratio."""
    t = F.col("n") / fs
    tone = F.sin(2 * math.pi * tone_hz * t) / (1 + F.exp(-20.0 * (t - onset_s)))
    toned = signal.withColumn("__tone", tone)
    gain = F.sqrt(ratio(F.var_pop("x").over(per_recording()), F.var_pop("__tone").over(per_recording()) * 10 ** (snr_db / 10)))
    return toned.withColumn("mixed", F.col("x") + gain * F.col("__tone")).drop("__tone")
