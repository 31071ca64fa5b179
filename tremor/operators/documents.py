"""Nested documents (JSON) as rows of paths, and which required entries they hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.operators.tables import keep


def normalised_key(c: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def flattened(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, kind, value): every entry of every document, containers (kind object or array) as well as scalars.

    A path joins the normalised names of objects and the places in arrays by underscores. Documents are variants; one pass for each level of nesting opens the
    containers that are left, so depth costs passes and breadth costs rows, and nothing is gathered. A document that can't be parsed, and a null
    one, has no entries. Scalars are text, containers JSON, a JSON null is null.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("id"), F.lit("").alias("path"), F.try_parse_json(document).alias("v"))
    parts = []
    while True:
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        name = F.coalesce(normalised_key(F.col("key")), F.col("pos").cast("string"))
        path = F.when(F.col("path") == "", name).otherwise(F.concat_ws("_", "path", name))
        kind = F.lower(F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0))
        made = keep(opened.select("id", path.alias("path"), kind.alias("kind"), F.col("value").alias("v")), "entries")
        inner = made.filter(F.col("kind").isin("object", "array"))
        parts.append(made.select(F.col("id").alias(key), "path", "kind", F.when(F.col("kind").isin("object", "array"), F.to_json("v")).when(F.col("kind") != "void", F.col("v").try_cast("string")).alias("value")))
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        level = inner.select("id", "path", "v")


def holds(key: Column, alias: str) -> Column:
    """Whether a normalised key holds the alias, or all words of the alias in their order."""
    words = alias.split("_")
    return F.contains(key, F.lit(alias)) | key.rlike("(^|_)" + "_(.*_)?".join(words) + "(_|$)")


def requirements(entries: DataFrame, key: str, wanted: dict[str, list[str]]) -> DataFrame:
    """(requirement, records, missing): how many records there are, and how many have no key that matches one of the requirement's aliases (normalised)."""
    found = [reduce(lambda a, b: a | b, [holds(F.col("path"), a) for a in aliases]).alias(name) for name, aliases in wanted.items()]
    per = entries.select(key, *found).groupBy(key).agg(*[F.bool_or(name).alias(name) for name in wanted])
    counts = per.agg(F.count("*").alias("records"), *[F.count_if(~F.col(name)).alias(name) for name in wanted])
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("requirement"), F.col(name).alias("missing")) for name in wanted])).alias("s")
    return counts.select("records", pairs).select("s.requirement", "records", "s.missing")  # one row, opened
