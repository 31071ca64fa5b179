"""Signals as rows: (recording_id, n, t, x), from the tables at hand; and as arrays, one row per recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.functions.expressions import ratio


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_signal(spark: SparkSession, sf_dir: str, fs: float = 100.0) -> DataFrame:
    """One recording per supplier: its line prices (in ten thousands), less their mean, in shipping order."""
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    by = Window.partitionBy("l_suppkey")
    order = by.orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    x = F.col("l_extendedprice") / 10000.0
    n = F.row_number().over(order) - 1
    return rows.select(F.col("l_suppkey").alias("recording_id"), n.cast("long").alias("n"), (n / fs).alias("t"), (x - F.avg(x).over(by)).alias("x"))


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per event type and user, so that none grows with the table: values by time, with their real, irregular timestamps in seconds."""
    rows = read(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id", "value")
    n = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")) - 1
    name = F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"))
    return rows.select(name.alias("recording_id"), n.cast("long").alias("n"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("x"))


def user_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per user: values / 100 by time, read as probabilities."""
    rows = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return rows.select(F.col("user_id").alias("recording_id"), n.cast("long").alias("n"), (F.col("value") / 100.0).alias("p"))


def embedding_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array recording per vector."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("recording_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def embedding_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_rows(embedding_arrays(spark, sf_dir))


def to_rows(arrays: DataFrame) -> DataFrame:
    return arrays.select("recording_id", F.posexplode("x").alias("n", "x")).select("recording_id", F.col("n").cast("long").alias("n"), "x")


def to_arrays(signal: DataFrame, value: str = "x") -> DataFrame:
    """One row per recording, values in order of n; the only shuffle that array kernels need."""
    pairs = F.array_sort(F.collect_list(F.struct("n", F.col(value).alias("v"))))
    return signal.groupBy("recording_id").agg(F.transform(pairs, lambda s: s["v"]).alias("x"))


def machining_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata row per supplier: spindle speed, teeth and geometry derived from its keys, nation and region."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    key = F.col("s_suppkey")
    return (
        s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))  # nations and regions are fixed small tables
        .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("recording_id"),
            (F.lit(300.0) + F.pmod(key, F.lit(7)) * 60).alias("rpm"),
            F.when(F.pmod(key, F.lit(11)) != 0, F.pmod(key, F.lit(4)).cast("int") + 1).alias("tooth_count"),
            (F.lit(2.0) + F.pmod(key, F.lit(3)) * 0.5).alias("stickout"),
            (F.pmod(key, F.lit(5)) * 0.005).alias("depth_of_cut"),
            F.col("n_name").alias("tool_identifier"),
            F.col("r_name").alias("label"),
        )
    )


def scaled(signal: DataFrame, percentile: float = 0.995) -> DataFrame:
    """x over a high percentile of its magnitude, with the factor that restores it."""
    factor = signal.groupBy("recording_id").agg(F.percentile(F.abs("x"), F.lit(percentile)).alias("scale_factor"))
    return signal.join(factor, "recording_id").withColumn("scaled", ratio(F.col("x"), F.col("scale_factor")))
