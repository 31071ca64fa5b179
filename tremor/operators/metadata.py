"""Matching recordings with machining metadata: exact paths, unique basenames, then bands of conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalised_path(c):
    """Forward slashes, and the default extension where there is none."""
    p = F.replace(c, F.lit("\\"), F.lit("/"))
    return F.when(p.rlike(r"\.[A-Za-z0-9]+$"), p).otherwise(F.concat(p, F.lit(".mat")))


def basename(c):
    return F.element_at(F.split(c, "/"), -1)


def first_per_path(metadata: DataFrame, order: str) -> DataFrame:
    """The first metadata row of each path; later ones are ambiguous and never applied."""
    w = Window.partitionBy("path").orderBy(order)
    return metadata.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def path_join(files: DataFrame, metadata: DataFrame, order: str) -> DataFrame:
    """Every file with the metadata of its normalised path, if any."""
    return files.join(first_per_path(metadata.withColumn("path", normalised_path(F.col("path"))), order), "path", "left")


def basename_join(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata rows whose basename names exactly one file; with how many files each one could mean."""
    named = files.withColumn("__base", basename(F.col("path")))
    counts = named.groupBy("__base").agg(F.count("*").alias("candidates"), F.min("path").alias("__file"))
    rows = metadata.withColumn("__base", basename(normalised_path(F.col("path"))))
    joined = rows.join(counts, "__base", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long")))
    status = F.when(F.col("candidates") == 1, "matched").when(F.col("candidates") > 1, "ambiguous").otherwise("unmappable")
    return joined.withColumn("status", status).withColumn("file", F.when(F.col("candidates") == 1, F.col("__file"))).drop("__base", "__file")


def band_join(left: DataFrame, right: DataFrame, key: str, tolerance: float, residual, equal: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows whose keys differ by the tolerance at most, as an equi-join on cells of that width and the neighbouring cells.

    residual gets the two key columns' names and gives a further condition.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    a = left.withColumn("__cell", cell(key))
    b = right.withColumnRenamed(key, f"{key}_right").withColumn("__cell", F.explode(F.array(*[F.floor(F.col(f"{key}_right") / tolerance).cast("long") + d for d in (-1, 0, 1)])))
    return a.join(b, ["__cell", *equal]).filter((F.abs(F.col(key) - F.col(f"{key}_right")) <= tolerance) & residual).drop("__cell")


def condition_of(path):
    """Stick-out, label, speed and depth from '<a>p<b>inch_stickout/<label>_<rpm>_<depth>.mat'."""
    stick = F.regexp_extract(path, r"([0-9]+(?:p[0-9]+)?)inch", 1)
    stem = F.regexp_replace(basename(path), r"\.[A-Za-z0-9]+$", "")
    part = lambda k: F.get(F.split(stem, "_"), k)
    number = lambda c: F.regexp_extract(c, "^([0-9]+)", 1).try_cast("double")  # noqa: E731  null where there is none
    return {
        "stickout": F.replace(stick, F.lit("p"), F.lit(".")).try_cast("double"),
        "label": part(0),
        "rpm": number(part(1)),
        "depth_of_cut": number(part(2)) / 1000,
    }
