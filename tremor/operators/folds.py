"""Leave one group out without a fit for each fold: sufficient statistics by group, subtracted from those of all.

A linear discriminant needs counts, sums and second moments only, and so does the scaling of its inputs. One pass gives them for every group (partial
sums inside tasks, so a group with a third of all rows is no hot task); all groups' sum less a group's own is what a fit on the other groups would
see. Each group's model comes from that difference inside tasks, however many groups there are, and every row is scored by the model that has
not seen its group. Features are taken relative to the mean of all rows, so that the differences lose no digits.

Models: "full" is the linear discriminant with a pooled covariance, "diagonal" the one that takes features as independent. Both work on features scaled
by the training groups' mean and deviation (1 where that is 0), with RIDGE added to the scaled variances, and weigh the classes equally. A fold whose training
groups hold one class has no model, and its rows no score. Rows with a null, NaN or infinite feature or no label take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.detection import confusion, roc_auc
from tremor.operators.tables import keep

RIDGE = 1e-3


def complete_rows(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """rows with features __x (an array) and label __y (0 or 1); incomplete ones are left out."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    good = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))) & F.col(label).isNotNull()
    return rows.withColumn("__x", x).withColumn("__y", (F.col(label) == 1).cast("int")).filter(good)


def group_statistics(rows: DataFrame, group: str, centre: np.ndarray, full: bool) -> DataFrame:
    """(group, s): for each group, the classes' counts, the classes' sums, and the upper triangle (or diagonal) of the second moments, of x - centre."""
    d = len(centre)
    upper = np.triu_indices(d) if full else (np.arange(d), np.arange(d))
    size = 2 + 2 * d + len(upper[0])

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.stack(pdf["__x"].to_numpy()) - centre
            y = pdf["__y"].to_numpy()
            codes, names = pd.factorize(pdf["g"], use_na_sentinel=False)
            values = np.concatenate([(1 - y)[:, None], y[:, None], x * (1 - y)[:, None], x * y[:, None], x[:, upper[0]] * x[:, upper[1]]], axis=1)
            order = np.argsort(codes, kind="stable")
            sums = np.add.reduceat(values[order], np.flatnonzero(np.diff(codes[order], prepend=-1)), axis=0)
            yield pd.DataFrame({"g": names, "s": list(sums)})

    kind = rows.schema[group].dataType.simpleString()
    parts = rows.select(F.col(group).alias("g"), "__x", "__y").mapInPandas(run, f"g {kind}, s array<double>")
    return parts.groupBy("g").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(size)]).alias("s"))


def discriminant(s: np.ndarray, d: int, full: bool) -> tuple[np.ndarray, float] | None:
    """Weights for x - centre and the constant, from statistics; None with one class."""
    n0, n1 = s[0], s[1]
    n = n0 + n1
    if n0 < 0.5 or n1 < 0.5:
        return None
    s0, s1, q = s[2 : 2 + d], s[2 + d : 2 + 2 * d], s[2 + 2 * d :]
    moments = np.zeros((d, d))
    if full:
        moments[np.triu_indices(d)] = q
        moments = np.triu(moments) + np.triu(moments, 1).T
    else:
        moments[np.arange(d), np.arange(d)] = q
    mean = (s0 + s1) / n
    variance = np.maximum(np.diag(moments) / n - mean * mean, 0.0)
    scale = np.where(variance > 0, np.sqrt(variance), 1.0)
    within = (moments - np.outer(s0, s0) / n0 - np.outer(s1, s1) / n1) / n / np.outer(scale, scale)
    if not full:
        within = np.diag(np.diag(within))
    m0, m1 = (s0 / n0 - mean) / scale, (s1 / n1 - mean) / scale
    w = np.linalg.solve(within + RIDGE * np.eye(d), m1 - m0)
    weights = w / scale
    return weights, float(-(w @ (m0 + m1)) / 2 - weights @ mean)


def with_models(rows: DataFrame, features: list[str], label: str, group: str, model: str) -> DataFrame:
    """Complete rows with __y, __x relative to the mean of all rows, and the weights __w and constant __b of their group's model (null without one)."""
    if model not in ("full", "diagonal"):
        raise ValueError("the model is full or diagonal")
    full, d = model == "full", len(features)
    data = complete_rows(rows, features, label)
    means = data.agg(*[F.avg(F.col("__x")[i]) for i in range(d)]).collect()[0]
    centre = np.array([m or 0.0 for m in means], dtype=float)
    per = keep(group_statistics(data, group, centre, full), "statistics")  # a row per group, read for the sum and for the models
    sums = per.agg(*[F.sum(F.col("s")[i]) for i in range(2 + 2 * d + (d * (d + 1) // 2 if full else d))]).collect()[0]  # a few numbers
    total = np.array([v or 0.0 for v in sums], dtype=float)

    def fit(frames):
        for pdf in frames:
            found = [discriminant(total - np.asarray(s), d, full) for s in pdf["s"]]
            yield pd.DataFrame({"__g": pdf["g"], "__w": [None if f is None else f[0] for f in found], "__b": [None if f is None else f[1] for f in found]})

    kind = rows.schema[group].dataType.simpleString()
    models = per.mapInPandas(fit, f"__g {kind}, __w array<double>, __b double")
    joined = data.join(models, F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
    return joined.withColumn("__x", F.zip_with("__x", F.array(*map(F.lit, centre.tolist())), lambda v, c: v - c))


def probability(x, w, b):
    """Of class 1, for arrays x and w."""
    return 1 / (1 + F.exp(-F.aggregate(F.zip_with(x, w, lambda v, u: v * u), b, lambda s, v: s + v)))


def leave_one_group_out(rows: DataFrame, features: list[str], label: str, group: str, model: str = "full") -> DataFrame:
    """Complete rows with __y and score, the probability of class 1 by the other groups' model; a null group is a group."""
    return with_models(rows, features, label, group, model).withColumn("score", probability(F.col("__x"), F.col("__w"), F.col("__b"))).drop("__x", "__w", "__b")


def pooled_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The usual metrics over all out-of-fold rows together, with the area under the curve (both classes needed)."""
    known = keep(scored.filter("score IS NOT NULL").select("__y", "score", (F.col("score") >= threshold).cast("int").alias("__p")), "scored")  # read four times
    return confusion(known, "__y", "__p").crossJoin(roc_auc(known, "__y", "score").select("auc"))  # one row each


def evaluate_groupings(rows: DataFrame, features: list[str], label: str, groupings: list[str], model: str = "full") -> DataFrame:
    """Pooled metrics of leaving out one group of each grouping."""
    parts = [pooled_metrics(leave_one_group_out(rows, features, label, g, model)).withColumn("grouping", F.lit(g)) for g in groupings]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ablation(rows: DataFrame, subsets: dict[str, list[str]], label: str, groupings: list[str], model: str = "full") -> DataFrame:
    """The same for subsets of the features; those of fewer than two are left out."""
    parts = [evaluate_groupings(rows, names, label, groupings, model).withColumn("subset", F.lit(s)) for s, names in subsets.items() if len(names) >= 2]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def permutation_importance(rows: DataFrame, features: list[str], label: str, group: str, keys: list[str], model: str = "full", repeats: int = 2, bucket: int = 512, seed: int = 3) -> DataFrame:
    """(feature, importance, repeats): mean loss of out-of-fold AUC when a feature's values change places among rows; keys tell rows apart.

    Cells (feature, repeat) stand side by side. In each, rows fall into random buckets of about `bucket` rows and pass the feature's value on along a random
    cycle, so no value is lost and no task sees all rows. Each row keeps its own fold's model.
    """
    held = with_models(rows, features, label, group, model).filter("__w IS NOT NULL")
    n = max(1, held.count())
    cells = held.withColumn("__f", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1)))).withColumn("__r", F.explode(F.when(F.col("__f") < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(repeats - 1)))))
    draw = F.xxhash64(*keys, "__f", "__r", F.lit(seed))
    dealt = cells.withColumn("__bucket", F.pmod(draw, F.lit(max(1, n // bucket)))).withColumn("__draw", F.xxhash64(draw, F.lit(1)))
    cycle = Window.partitionBy("__f", "__r", "__bucket").orderBy("__draw", *keys)
    value = F.get("__x", F.col("__f"))
    last = F.last(value).over(cycle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    passed = F.coalesce(F.lag(value).over(cycle), last)
    moved = dealt.withColumn("__v", passed).withColumn("__x", F.transform("__x", lambda v, i: F.when(i == F.col("__f"), F.col("__v")).otherwise(v)))
    scored = moved.select("__f", "__r", "__y", probability(F.col("__x"), F.col("__w"), F.col("__b")).alias("score"))
    each = auc_by(scored, ["__f", "__r"], "__y", "score")
    whole = each.filter("__f < 0").select(F.col("auc").alias("__whole"))
    names = F.array(*map(F.lit, features))
    lost = each.filter("__f >= 0").crossJoin(F.broadcast(whole))  # one row
    return lost.groupBy(F.get(names, F.col("__f")).alias("feature")).agg(F.avg(F.col("__whole") - F.col("auc")).alias("importance"), F.count("*").alias("repeats"))


def auc_by(rows: DataFrame, by: list[str], truth: str, score: str, bins: int = 4096) -> DataFrame:
    """Area under the curve of each cell, from counts of scores in [0, 1] rounded to 1 / bins: as many rows a cell as bins at most."""
    counted = rows.withColumn("__s", F.round(F.col(score) * bins).cast("int")).groupBy(*by, "__s").agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    above = F.coalesce(F.sum("pos").over(Window.partitionBy(*by).orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = counted.withColumn("__won", F.col("neg") * (above + F.col("pos") / 2))
    return won.groupBy(*by).agg((F.sum("__won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def perturbation_stability(rows: DataFrame, features: list[str], label: str, group: str, keys: list[str], scale: float = 0.01, seeds: tuple[int, ...] = (42, 100, 500, 999, 1234), model: str = "full") -> DataFrame:
    """(seeds, mean, std): accuracy out of fold when normal deviates of the given size are added to every feature, over seeds; keys tell rows apart.

    A deviate comes from two hashes of keys, feature and seed, so it is the same in every run.
    """
    unit = lambda j, s, k: (F.pmod(F.xxhash64(*keys, F.lit(j), F.lit(s), F.lit(k)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    parts = []
    for s in seeds:
        noisy = rows.withColumns({f: F.col(f) + scale * F.sqrt(-2 * F.log(unit(j, s, 1))) * F.cos(2 * np.pi * unit(j, s, 2)) for j, f in enumerate(features)})
        parts.append(pooled_accuracy(leave_one_group_out(noisy, features, label, group, model)).withColumn("seed", F.lit(s)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.count("*").alias("seeds"), F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))


def pooled_accuracy(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    known = scored.filter("score IS NOT NULL").withColumn("__p", (F.col("score") >= threshold).cast("int"))
    return confusion(known, "__y", "__p").select("accuracy")
