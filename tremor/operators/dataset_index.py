"""A dataset index: every recording with the machining condition that a metadata table gives for it.

Conditions are matched by several keys at once, each within a tolerance. Distinct conditions of the files meet distinct conditions of the metadata,
so a condition that a third of all recordings share is matched once, and so is one that the metadata repeats. The join is an equi-join on cells: on
each axis a value lies in one cell and reaches the cells its tolerance touches, mostly one. A cascade goes from tight to loose tolerances; what a tighter
level has matched is out of the looser ones, and within a level the first metadata row in order wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.functions.expressions import standard_label
from tremor.operators.metadata import basename, condition_of
from tremor.operators.tables import keep


@dataclass(frozen=True)
class Within:
    """Two values agree when |a - b| <= max(relative * max(|a|, |b|), absolute); strict: < instead of <=. The relative part must be under 0.1."""

    key: str
    absolute: float
    relative: float = 0.0
    strict: bool = False

    def agrees(self, a: Column, b: Column) -> Column:
        bound = F.greatest(F.lit(self.relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(self.absolute))
        return F.abs(a - b) < bound if self.strict else F.abs(a - b) <= bound

    def place(self, c: Column) -> Column:
        """An increasing function of the value in which agreeing values lie no more than 1.25 apart: even up to the value where the relative part takes over, logarithmic beyond."""
        even = c / F.lit(self.absolute)
        if not self.relative:
            return even
        turn = self.absolute / self.relative
        beyond = F.signum(c) * (F.lit(1 / self.relative) + F.log(F.abs(c) / turn) / F.lit(self.relative))
        return F.when(F.abs(c) <= turn, even).otherwise(beyond)


#: Cells are this many tolerances wide, so a value's reach mostly stays inside its own.
WIDTH, REACH = 8.0, 1.26


def conditions_within(left: DataFrame, right: DataFrame, bands: list[Within]) -> DataFrame:
    """Pairs of rows whose keys all agree; right's columns get the suffix _right where left has the name too. Null and non-finite keys agree with nothing."""
    keys = [b.key for b in bands]
    known = lambda df: df.filter(reduce(lambda a, b: a & b, [F.abs(F.col(k).cast("double")) < math.inf for k in keys]))  # noqa: E731  false for NaN, which is the largest value
    a, b = known(left), known(right)
    clash = [c for c in b.columns if c in a.columns]
    b = b.withColumnsRenamed({c: f"{c}_right" for c in clash})
    cell = lambda p: F.floor(p / WIDTH).cast("long")
    names = [f"__cell{i}" for i in range(len(bands))]
    for name, band in zip(names, bands, strict=True):
        a = a.withColumn(name, cell(band.place(F.col(band.key).cast("double"))))
        p = band.place(F.col(f"{band.key}_right").cast("double"))
        b = b.withColumn(name, F.explode(F.sequence(cell(p - REACH), cell(p + REACH))))
    agree = reduce(lambda x, y: x & y, [band.agrees(F.col(band.key).cast("double"), F.col(f"{band.key}_right").cast("double")) for band in bands])
    return a.join(b, names).filter(agree).drop(*names)


def first_match(files: DataFrame, metadata: DataFrame, levels: list[tuple[str, list[Within]]], order: str) -> DataFrame:
    """files with the number (order) of the metadata row that describes them, and the level at which it matched; null where none does.

    All levels have the same keys. Conditions are matched, not files: the metadata's first row of each distinct condition stands for all its copies.
    """
    keys = [b.key for b in levels[0][1]]
    conditions = keep(files.select(*keys).distinct(), "conditions")
    rows = keep(metadata.groupBy(*keys).agg(F.min(order).alias("__order")), "rows")
    found, open_ = [], conditions
    for name, bands in levels:
        hit = keep(conditions_within(open_, rows, bands).groupBy(*keys).agg(F.min("__order").alias(order)).withColumn("match", F.lit(name)), "hit")
        found.append(hit)
        open_ = open_.join(hit, keys, "left_anti")
    matched = reduce(DataFrame.unionByName, found)
    return files.join(matched, keys, "left")


#: The reference condition match, and the looser one of a workbook whose sheets round their values.
TIGHT = ("tight", [Within("stickout", 1e-9, 1e-9), Within("rpm", 1e-9, 1e-9), Within("depth_of_cut", 5e-7, 1e-9)])
LOOSE = ("loose", [Within("stickout", 0.1, strict=True), Within("rpm", 1e-9, 1e-9), Within("depth_of_cut", 1e-3, strict=True)])
#: What a recording has where no metadata row describes it (fixed values).
DEFAULTS = {"feed_rate": 0.002, "tooth_count": 1, "tool_id": "tool_01", "machine_id": "lathe_01", "sensor_id": "accelerometer_01", "chatter_onset_time": 0.0}


def combinations(cells: DataFrame) -> DataFrame:
    """Rows (ord, stickout, rpm, depth_of_cut, feed_rate, label) of workbook rows (sheet, ord, header -> text map cells).

    The first of several possible headers counts; a row without speed, depth or a state column is none. Where a sheet has no stick-out column, or
    a row no readable value in it, the sheet's name tells (rod<a>p<b>inch, else 3p5, 4p125, 4p5), and 2 is the default.
    """
    number = lambda c: c.try_cast("double")
    first = lambda *names: F.coalesce(*[F.when(F.map_contains_key("cells", n), F.col("cells")[n]) for n in names])
    known = lambda *names: reduce(lambda a, b: a | b, [F.map_contains_key("cells", F.lit(n)) for n in names])
    rod = lambda k: F.nullif(F.regexp_extract("sheet", r"rod([0-9]+)p?([0-9]*)inch", k), F.lit(""))
    by_name = F.coalesce(
        rod(1).cast("double") + F.coalesce(rod(2).cast("double") / 10, F.lit(0.0)),
        F.when(F.contains("sheet", F.lit("3p5")), 3.5).when(F.contains("sheet", F.lit("4p125")), 4.125).when(F.contains("sheet", F.lit("4p5")), 4.5).otherwise(2.0),
    )
    ld = first("l/d", "ld")
    rows = cells.select(
        "ord",
        F.when(ld.isNotNull(), F.coalesce(number(ld), F.lit(2.0))).otherwise(by_name).alias("stickout"),
        F.floor(number(first("rpm", "spindle speed"))).cast("double").alias("rpm"),
        number(first("doc (in)", "corrected doc (in)", "doc")).alias("depth_of_cut"),
        F.coalesce(number(first("feed (in/rev)", "feed", "feedrate")), F.lit(DEFAULTS["feed_rate"])).alias("feed_rate"),
        standard_label(F.coalesce(first("state", "chatter/nochatter", "status"), F.lit(""))).alias("label"),
        known("state", "chatter/nochatter", "status").alias("__stated"),
    )
    return rows.filter("__stated AND rpm IS NOT NULL AND depth_of_cut IS NOT NULL").drop("__stated")


def dataset_index(files: DataFrame, metadata: DataFrame, levels: list[tuple[str, list[Within]]] | None = None) -> DataFrame:
    """One row for each path of files: its condition by folder and name, the first metadata row (ord, stickout, rpm, depth_of_cut, feed_rate, label) that agrees, and a label in any case.

    Where nothing agrees, the name's first letter tells the label (s stable, i incipient, else chatter). A path that can't be read, and an id that
    several paths have, get a problem; they stay in the table.
    """
    stem = F.regexp_replace(basename(F.col("path")), r"\.mat$", "")
    part = F.split(stem, "_")
    named = files.select("path", *[c.alias(n) for n, c in condition_of(F.col("path")).items()]).withColumnRenamed("label", "prefix")
    named = named.withColumn("experiment_run_id", F.coalesce(F.get(part, 3), F.lit("1")))
    problem = F.when(F.col("stickout").isNull(), "unknown stick-out folder").when(F.size(part) < 3, "name has too few parts").when(F.col("rpm").isNull() | F.col("depth_of_cut").isNull(), "speed or depth can't be read")
    ids = F.concat_ws("_", F.lit("ld"), F.col("stickout").cast("string"), F.lit("rpm"), F.col("rpm").cast("long").cast("string"), F.lit("doc"), F.col("depth_of_cut").cast("string"), F.lit("state"), "prefix", F.lit("run"), "experiment_run_id")
    named = named.withColumn("problem", problem).withColumn("recording_id", F.when(F.col("problem").isNull(), ids))
    copies = named.filter("recording_id IS NOT NULL").groupBy("recording_id").agg(F.count("*").alias("__n")).filter("__n > 1")
    named = named.join(copies, "recording_id", "left").withColumn("problem", F.coalesce("problem", F.when(F.col("__n") > 1, "several paths have this id"))).drop("__n")
    levels = levels or [TIGHT, LOOSE]
    keys = [b.key for b in levels[0][1]]
    matched = first_match(named.select(*keys).distinct(), metadata, levels, "ord")
    facts = metadata.select("ord", "feed_rate", F.col("label").alias("__label"))
    found = matched.filter("ord IS NOT NULL").join(facts, "ord")  # facts go to conditions: files without a match, or of one that many share, would meet in one task
    by_name = F.when(F.col("prefix") == "s", "stable").when(F.col("prefix") == "i", "incipient").otherwise("chatter")
    joined = named.join(found, keys, "left")
    return joined.select(
        "recording_id", "path", "stickout", "rpm", "depth_of_cut", F.coalesce("feed_rate", F.lit(DEFAULTS["feed_rate"])).alias("feed_rate"),
        *[F.lit(DEFAULTS[n]).alias(n) for n in ("tooth_count", "tool_id", "machine_id", "sensor_id", "chatter_onset_time")],
        F.coalesce("__label", by_name).alias("label"), "experiment_run_id", F.coalesce("match", F.lit("name")).alias("match"), "ord", "problem",
    )
