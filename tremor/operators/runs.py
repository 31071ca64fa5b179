"""A run over a data set that takes up where the last one stopped: what hasn't changed is not worked on again, and what fails doesn't end the run.

A run's folder holds results and a manifest, both in partitions by a hash of the recording (BUCKETS of them, so that files stay few). The manifest
has a row for each recording: the digest of its content and of the run's configuration, whether it worked out, or the error. Inputs whose digest
stands in the manifest as worked out are left alone; new, changed and failed ones are worked on, and recordings that are no longer there are taken
out. Only partitions with a change are written again, results first: a run that is lost in between does its work again, and never believes a
manifest without results. What goes into a partition is written to the shared folder first, since it may come from that partition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.operators.tables import keep

BUCKETS = 64
_MANIFEST = "recording_id string, digest string, status string, error string, bucket int"


def content_digest(payload: str, configuration: str) -> Column:
    """SHA-256 of the configuration and of an array's values (each double by its own text)."""
    return F.sha2(F.concat_ws("\n", F.lit(configuration), F.to_json(F.struct(F.transform(F.col(payload), lambda v: v.cast("string")).alias("v")))), 256)


def stored(spark, path: str, schema: str) -> DataFrame:
    """A table of the run's folder, empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def attempted(rows: DataFrame, kernel: Callable[[np.ndarray], tuple], fields: list[T.StructField]) -> DataFrame:
    """rows (recording_id, digest, bucket, x) with fields from kernel(x) instead of x, and error: what the kernel raised, null if it worked out."""
    names = [f.name for f in fields]
    schema = T.StructType([*(rows.schema[c] for c in ("recording_id", "digest", "bucket")), *fields, T.StructField("error", T.StringType())])

    def one(x) -> tuple:
        try:
            return (*kernel(np.asarray(x, dtype=float)), None)
        except Exception as e:  # this recording's failure is a row
            return (*[None] * len(names), f"{type(e).__name__}: {e}")

    def run(frames):
        for pdf in frames:
            made = pd.DataFrame([one(x) for x in pdf["x"]], columns=[*names, "error"], index=pdf.index, dtype=object)
            yield pd.concat([pdf[["recording_id", "digest", "bucket"]], made], axis=1)

    return rows.mapInPandas(run, schema)


def run_dataset(inputs: DataFrame, folder: str, kernel: Callable[[np.ndarray], tuple], fields: list[T.StructField], configuration: str) -> DataFrame:
    """Works on what of inputs (recording_id, x) is new, changed or failed before, and returns the manifest with touched, whether this run worked on the recording.

    folder/results has (recording_id, fields, bucket) of the recordings that worked out. Rows that share an id are an error of that id.
    """
    spark = inputs.sparkSession
    result_schema = "recording_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", bucket int"
    old = stored(spark, f"{folder}/manifest", _MANIFEST)
    now = inputs.select(F.col("recording_id").cast("string").alias("recording_id"), "x", content_digest("x", configuration).alias("digest"))
    now = now.groupBy("recording_id").agg(F.count("*").alias("__n"), F.min_by("x", "digest").alias("x"), F.min("digest").alias("digest"))
    now = now.withColumn("bucket", F.pmod(F.xxhash64("recording_id"), F.lit(BUCKETS)).cast("int"))
    done = old.filter("status = 'done'").select("recording_id", "digest")
    todo = keep(now.join(done, ["recording_id", "digest"], "left_anti"), "todo")
    gone = keep(old.join(now.select("recording_id"), "recording_id", "left_anti").select("recording_id", "bucket"), "gone")
    made = attempted(todo.filter("__n = 1"), kernel, fields)
    twice = todo.filter("__n > 1").select("recording_id", "digest", "bucket", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], F.lit("several inputs have this id").alias("error"))
    made = keep(made.unionByName(twice), "made")
    changed = todo.select("bucket").union(gone.select("bucket")).distinct()  # at most BUCKETS rows
    moved = todo.select("recording_id").union(gone.select("recording_id"))

    def rewritten(name: str, before: DataFrame, fresh: DataFrame) -> None:
        held = before.join(F.broadcast(changed), "bucket", "left_semi").join(moved, "recording_id", "left_anti")
        rows = keep(held.unionByName(fresh), name)
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{folder}/{name}")
        # a changed bucket of which nothing is left must go as well
        left = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
        for bucket in sorted({r["bucket"] for r in changed.collect()} - left):
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/bucket={bucket}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    names = [f.name for f in fields]
    rewritten("results", stored(spark, f"{folder}/results", result_schema), made.filter("error IS NULL").select("recording_id", *names, "bucket"))
    fresh = made.select("recording_id", "digest", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error", "bucket")
    rewritten("manifest", old, fresh)
    manifest = stored(spark, f"{folder}/manifest", _MANIFEST)
    touched = made.select("recording_id", F.lit(True).alias("touched"))
    return manifest.join(touched, "recording_id", "left").withColumn("touched", F.coalesce("touched", F.lit(False)))
