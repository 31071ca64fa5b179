"""Validation of recordings: rules as columns, violations as rows, nothing raised."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions.expressions import ratio

TINY, EPS = 2.2250738585072014e-308, 2.220446049250313e-16


def timing(signal: DataFrame) -> DataFrame:
    """Per recording: samples, median step, least step, relative jitter and estimated rate."""
    step = signal.select("recording_id", "n", "t", "x", (F.col("t") - F.lag("t").over(Window.partitionBy("recording_id").orderBy("n"))).alias("dt"))
    spread = step.join(step.groupBy("recording_id").agg(F.median("dt").alias("__median")), "recording_id")
    size = spread.groupBy("recording_id").agg(
        F.count("*").alias("samples"),
        F.first("__median", ignorenulls=True).alias("median_dt"),
        F.min("dt").alias("least_dt"),
        F.max(F.abs(F.col("dt") - F.col("__median"))).alias("__off"),
        F.count_if(F.isnan("x") | (F.abs("x") == float("inf")) | F.col("x").isNull()).alias("bad_values"),
        F.max(F.abs("x")).alias("largest"),
        F.stddev_pop("x").alias("deviation"),
    )
    return size.withColumn("jitter", ratio(F.col("__off"), F.col("median_dt"))).withColumn("rate", ratio(F.lit(1.0), F.col("median_dt"))).drop("__off")


def validate(signal: DataFrame, configured_fs: float, rate_tolerance: float = 0.01, max_jitter: float = 0.05, min_seconds: float = 1.0, min_samples: int = 3, min_rate: float = 1e-3, max_rate: float = 1e7) -> DataFrame:
    """timing() with violations (sorted names of broken rules, comma-joined) and a status."""
    rules = {
        "duration": F.col("samples") * F.col("median_dt") < min_seconds - 1e-6,
        "finite": F.col("bad_values") > 0,
        "flat": (F.col("largest") <= TINY) | (F.col("deviation") <= EPS * F.col("largest")),
        "jitter": F.col("jitter") > max_jitter,
        "rate_bounds": ~F.col("rate").between(min_rate, max_rate),
        "rate_mismatch": F.abs(F.col("rate") - configured_fs) / configured_fs > rate_tolerance,
        "samples": F.col("samples") < min_samples,
        "time_order": F.col("least_dt") <= 0,
    }
    broken = F.concat_ws(",", *[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()])
    return timing(signal).withColumn("violations", broken).withColumn("status", F.when(F.col("violations") == "", "valid").otherwise("invalid"))


def physics_reason(rpm, teeth):
    """Why a row's machining metadata can't be used; NULL if it can."""
    bad = lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))
    return (
        F.when(bad(rpm), "rpm is missing")
        .when(rpm <= 0, "rpm is not positive")
        .when(bad(teeth), "tooth count is missing")
        .when((teeth < 1) | (teeth != F.floor(teeth)), "tooth count is not a positive integer")
    )


def duplicate_ids(ids: DataFrame, column: str) -> DataFrame:
    return ids.groupBy(column).agg(F.count("*").alias("copies")).filter("copies > 1")


def aligned_features(features: DataFrame) -> DataFrame:
    """Features present and finite in every (recording, window), with the evidence; features is long: feature, value."""
    rows = features.select("recording_id", "window_index").distinct().count()
    ok = F.count_if(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return features.groupBy("feature").agg(F.count("*").alias("present"), ok.alias("finite")).withColumn("kept", F.col("finite") == rows)
