"""Tables over long features: (recording_id, window_index, feature, value), value NULL with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions.expressions import correlation, ratio
from tremor.operators.tables import keep

EPS = 2.220446049250313e-16


def to_long(wide: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """One row per key and feature; a NULL value carries a reason."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    rows = wide.select(*keys, F.explode(pairs).alias("s")).select(*keys, "s.*")
    return rows.withColumn("reason", F.when(F.col("value").isNull(), "undefined for this window"))


def to_wide(long: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """A column per feature, by an explicit list (no job to find the names)."""
    return long.groupBy(*keys).pivot("feature", names).agg(F.first("value"))


def summary_population(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


#: Values that a task may sort for one wanted rank.
ALONE = 10_000


def exact_quantiles(rows: DataFrame, by: str, value: str, probabilities: list[float], alone: int = ALONE) -> DataFrame:
    """(by, q): exact quantiles of each group's values (null and NaN left out), linear between neighbouring ranks.

    Each wanted rank lies in a range of values, at first the group's whole. While a range holds more than `alone` values it is cut at 32 approximate quantiles of
    what it holds; counts of the pieces say which one the rank lies in, and a piece of one value is the answer. What is left are ranges
    that a task can sort. So no task sees a group, and a pass leaves about a thirtieth of the values. Null groups are left out.
    """
    v = F.col(value).cast("double")
    values = keep(rows.select(F.col(by).alias("g"), v.alias("v")).filter(F.col("g").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v")), "values")
    whole = values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities)]))
    asked = whole.select("*", place.alias("s")).withColumn("at", F.col("s.p") * (F.col("n") - 1)).select("g", F.col("s.i").alias("i"), "n", "lo", "hi", "at")
    asked = keep(asked, "asked")
    ranks = asked.select("g", "lo", "hi", "n", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("k")).distinct()
    ranges = keep(ranks.select("g", "k", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("held")), "ranges")
    while True:
        open_ = ranges.filter((F.col("held") > alone) & (F.col("lo") < F.col("hi")))
        if open_.isEmpty():
            break
        spans = open_.select("g", "lo", "hi").distinct()
        inside = values.join(spans, "g").filter("v >= lo AND v <= hi")
        edges = inside.groupBy("g", "lo", "hi").agg(F.array_distinct(F.percentile_approx("v", F.array(*[F.lit(j / 32) for j in range(1, 32)]), F.lit(1000))).alias("edges"))
        piece = F.struct(F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("below"), F.when(F.array_contains("edges", F.col("v")), 0).otherwise(1).alias("edge")).alias("piece")  # between two edges: after the lower one
        counted = inside.join(keep(edges, "edges"), ["g", "lo", "hi"]).groupBy("g", "lo", "hi", piece).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        ahead = F.coalesce(F.sum("c").over(Window.partitionBy("g", "lo", "hi").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 63 pieces
        pieces = counted.withColumn("ahead", ahead)
        found = open_.join(pieces, ["g", "lo", "hi"]).filter("k >= before + ahead AND k < before + ahead + c")
        narrowed = found.select("g", "k", F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("before") + F.col("ahead")).alias("before"), F.col("c").alias("held"))
        ranges = keep(ranges.filter((F.col("held") <= alone) | (F.col("lo") == F.col("hi"))).unionByName(narrowed), "ranges")
    spans = ranges.filter("lo < hi").select("g", "lo", "hi", "before").distinct()
    order = F.row_number().over(Window.partitionBy("g", "lo", "hi").orderBy("v")) - 1
    sorted_ = values.join(spans, "g").filter("v >= lo AND v <= hi").select("g", (F.col("before") + order).alias("k"), "v")
    alone_ = ranges.filter("lo = hi").select("g", "k", F.col("lo").alias("v"))
    at_rank = alone_.unionByName(ranges.select("g", "k").join(sorted_, ["g", "k"], "left_semi").join(sorted_, ["g", "k"]).dropDuplicates(["g", "k"]))
    at_rank = keep(at_rank, "ranks")
    low, high = (at_rank.select("g", F.col("k").alias(f"k{i}"), F.col("v").alias(f"v{i}")) for i in (0, 1))
    placed = asked.withColumn("k0", F.floor("at")).withColumn("k1", F.ceil("at")).join(low, ["g", "k0"]).join(high, ["g", "k1"])
    q = placed.withColumn("v", F.col("v0") + F.when(F.col("v1") > F.col("v0"), (F.col("v1") - F.col("v0")) * (F.col("at") - F.col("k0"))).otherwise(0.0))
    pairs = F.array_sort(F.collect_list(F.struct("i", "v")))
    return q.groupBy(F.col("g").alias(by)).agg(F.transform(pairs, lambda s: s["v"]).alias("q"))


def describe(long: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, exact quartiles and range of each feature."""
    made = long.groupBy("feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    made = made.join(exact_quantiles(long, "feature", "value", [0.25, 0.5, 0.75]), "feature", "left")
    return made.select("feature", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def missingness(long: DataFrame) -> DataFrame:
    """Missing values of each feature, their share, and each reason's count."""
    each = long.groupBy("feature", "reason").agg(F.count("*").alias("n"))
    pair = F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))
    made = each.groupBy("feature").agg(F.sum(F.when(F.col("reason").isNotNull(), F.col("n")).otherwise(0)).alias("missing"), F.sum("n").alias("total"), F.array_sort(F.collect_list(pair)).alias("__r"))
    reasons = F.array_join(F.transform("__r", lambda s: F.concat_ws("=", s["reason"], s["n"].cast("string"))), ";")
    return made.select("feature", "missing", "total", ratio(F.col("missing").cast("double"), F.col("total").cast("double")).alias("fraction"), reasons.alias("reasons"))


def finite_or_explained(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: values, those that are missing or not finite, those of them without a reason, and whether there are none of the last."""
    odd = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    bare = odd & (F.coalesce(F.trim("reason"), F.lit("")) == "")
    made = long.groupBy(*keys).agg(F.count("*").alias("values"), F.count_if(odd).alias("nonfinite"), F.count_if(bare).alias("unexplained"))
    return made.withColumn("explained", F.col("unexplained") == 0)


def correlations(long: DataFrame, keys: list[str]) -> DataFrame:
    """Pairwise-complete correlation of every two features (a <= b); NULL under two pairs or without spread."""
    rows = long.filter("value IS NOT NULL").select(*keys, "feature", "value")
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("f"))  # the features of one window: a short list
    pairs = lists.select(F.explode("f").alias("a"), "f").select("a", F.explode("f").alias("b")).filter("a.feature <= b.feature")
    return pairs.groupBy(F.col("a.feature").alias("a"), F.col("b.feature").alias("b")).agg(F.when(F.count("*") >= 2, correlation(F.col("a.value"), F.col("b.value"))).alias("correlation"), F.count("*").alias("pairs"))


def grouped_means(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Means by each single group column in one pass (grouping sets), with z-scores against the median of its groups."""
    made = rows.select(*groups, value).groupingSets([[F.col(g)] for g in groups], *groups).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.grouping_id().alias("__g"))
    by = F.coalesce(*[F.when(F.col("__g") == sum(1 << (len(groups) - 1 - j) for j in range(len(groups)) if j != i), F.lit(g)) for i, g in enumerate(groups)])
    key = F.coalesce(*[F.col(g).cast("string") for g in groups])
    named = made.select(by.alias("grouping"), key.alias("key"), "mean", "n").filter("key IS NOT NULL")
    named = keep(named, "means")
    middle = exact_quantiles(named, "grouping", "mean", [0.5]).join(named.groupBy("grouping").agg(F.stddev_pop("mean").alias("__s")), "grouping")
    spread = F.coalesce(F.nullif(F.col("__s"), F.lit(0.0)), F.lit(1.0))
    return named.join(F.broadcast(middle), "grouping").withColumn("z", (F.col("mean") - F.col("q")[0]) / spread).drop("q", "__s")  # a row for each grouping


def means_by(rows: DataFrame, groupings: list[list[str]], value: str) -> DataFrame:
    """Mean and count for each combination of each grouping's columns, in one pass; columns outside a grouping are NULL, and grouping names its columns."""
    every = sorted({c for g in groupings for c in g})
    known = rows.select(*every, value)
    made = known.groupingSets([[F.col(c) for c in g] for g in groupings], *every).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping_id().alias("__g"))
    name = F.coalesce(*[F.when(F.col("__g") == sum(1 << (len(every) - 1 - j) for j, c in enumerate(every) if c not in g), F.lit(",".join(g))) for g in groupings])
    return made.select(name.alias("grouping"), *every, "mean", "n")


def repeatability(reference: DataFrame, repeated: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Per feature: largest difference, comparisons, and whether values, gaps and reasons all agree (full outer by key)."""
    a = reference.select(*keys, "feature", F.col("value").alias("va"), F.col("reason").alias("ra"), F.lit(1).alias("ia"))
    b = repeated.select(*keys, "feature", F.col("value").alias("vb"), F.col("reason").alias("rb"), F.lit(1).alias("ib"))
    both = a.join(b, [*keys, "feature"], "full_outer")
    gap = F.abs(F.col("va") - F.col("vb"))
    same = (F.col("ia").isNotNull() & F.col("ib").isNotNull() & F.col("ra").eqNullSafe(F.col("rb"))) & ((F.col("va").isNull() & F.col("vb").isNull()) | (gap <= tolerance + tolerance * F.abs(F.col("vb"))))
    return both.groupBy("feature").agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("max_difference"), F.count(gap).alias("comparisons"), F.bool_and(F.coalesce(same, F.lit(False))).alias("deterministic"))


def merge_repeatability(parts: DataFrame) -> DataFrame:
    return parts.groupBy("feature").agg(F.max("max_difference").alias("max_difference"), F.sum("comparisons").alias("comparisons"), F.bool_and("deterministic").alias("deterministic"))


def selection_frequency(candidates: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """How often each candidate was chosen, zero included."""
    return candidates.join(chosen.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def family_medians(long: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Median magnitude of each feature family."""
    rows = long.join(F.broadcast(catalogue), "feature")  # the catalogue is a fixed list
    medians = exact_quantiles(rows.withColumn("value", F.abs("value")), "family", "value", [0.5])
    named = rows.groupBy("family").agg(F.count_distinct("feature").alias("features"))
    return named.join(medians, "family", "left").select("family", F.col("q")[0].alias("median_magnitude"), "features")


def scalar_summary(values: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, population deviation and the 95 % interval of the mean over seeds."""
    half = 1.96 * F.stddev_pop(value) / F.sqrt(F.count(value).cast("double"))
    return values.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def best_models(scores: DataFrame, setting: str, model: str, score: str) -> DataFrame:
    """The model with the highest score in each setting; a missing score counts as -1, ties go to the first name."""
    rank = F.struct(F.when(F.col(score).isNotNull() & ~F.isnan(score), F.col(score)).otherwise(-1.0).alias("s"))
    best = Window.partitionBy(setting).orderBy(rank.desc(), model)  # a row for each model
    return scores.withColumn("__k", F.row_number().over(best)).filter("__k = 1").drop("__k")


def model_ranking(scores: DataFrame, setting: str, model: str, score: str, others: list[str]) -> DataFrame:
    """Each model's mean score and means of others over the settings (a NaN stays one), in how many settings it is best, and its place by the mean score."""
    wins = best_models(scores, setting, model, score).groupBy(model).agg(F.count("*").alias("wins"))
    means = scores.groupBy(model).agg(F.avg(score).alias(score), *[F.avg(c).alias(c) for c in others])
    place = F.row_number().over(Window.orderBy(F.desc(score), model))  # a row for each model
    return means.join(wins, model, "left").withColumn("wins", F.coalesce("wins", F.lit(0).cast("long"))).withColumn("place", place)


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Values of two runs side by side with their difference; keys of either run stay."""
    return a.select(key, F.col(value).alias("baseline")).join(b.select(key, F.col(value).alias("candidate")), key, "full_outer").withColumn("delta", F.col("candidate") - F.col("baseline"))
