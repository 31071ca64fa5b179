"""Detection metrics and statistics over rows of (truth, score)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.functions.expressions import ratio
from tremor.operators.tables import keep


def confusion(rows: DataFrame, truth: str, predicted: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts and the usual ratios; a ratio without a denominator is 0, balanced accuracy with one class is the accuracy."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    made = rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    d = lambda a, b: ratio(a.cast("double"), b.cast("double"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    made = made.withColumns({"accuracy": d(tp + tn, tp + fp + fn + tn), "precision": F.coalesce(d(tp, tp + fp), zero), "recall": F.coalesce(d(tp, tp + fn), zero)})
    made = made.withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
    return made.withColumn("balanced_accuracy", F.coalesce((d(tp, tp + fn) + d(tn, tn + fp)) / 2, F.col("accuracy")))


#: Ranges of scores over which cumulated counts are worked out side by side.
RANGES = 256


def _cuts(rows: DataFrame, value: str, ranges: int) -> list[float]:
    """Approximate quantiles that cut the values into ranges; none for no rows."""
    if ranges < 2:
        return []
    found = rows.agg(F.percentile_approx(value, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(2 * ranges))).collect()[0][0]
    return sorted(set(found or []))


def _cumulated(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, pos, neg) of each distinct score with pos_above and neg_above, the counts of higher scores.

    Scores fall into ranges by approximate quantiles (at most RANGES numbers pass the driver); each range is summed in a task of its own, on
    top of the whole counts of the ranges above it.
    """
    known = rows.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
    per = known.groupBy(F.col(score).cast("double").alias("__v"), F.col(score)).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    cuts = _cuts(per, "__v", RANGES)
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("__v"))) if cuts else F.lit(0)
    ranged = per.withColumn("__part", part)
    whole = Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows
    above = ranged.groupBy("__part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select("__part", F.coalesce(F.sum("p").over(whole), F.lit(0)).alias("__p"), F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("__n"))
    inside = Window.partitionBy("__part").orderBy(F.desc("__v")).rowsBetween(Window.unboundedPreceding, -1)
    made = ranged.join(F.broadcast(above), "__part")
    return made.select(score, "pos", "neg", *((F.col(f"__{c[0]}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_above") for c in ("pos", "neg")))


def roc_auc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the curve over distinct scores (ties count half); NULL with one class."""
    won = _cumulated(rows, truth, score).withColumn("w", F.col("neg") * (F.col("pos_above") + F.col("pos") / 2))
    return won.agg(ratio(F.sum("w").cast("double"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def roc_curve(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Cumulated true and false positive rates at each distinct score, highest first."""
    made = _cumulated(rows, truth, score)
    total = F.broadcast(made.agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n")))  # one row
    rate = lambda c, t: ratio((F.col(c) + F.col(f"{c}_above")).cast("double"), F.col(t).cast("double"))
    return made.crossJoin(total).select(score, rate("pos", "__p").alias("tpr"), rate("neg", "__n").alias("fpr"))


def precision_recall(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Precision and recall when all scores from this one up are positive, with the step that recall rises by here; the steps times the precisions sum to the average precision."""
    made = _cumulated(rows, truth, score)
    total = F.broadcast(made.agg(F.sum("pos").alias("__p")))  # one row
    tp, fp = F.col("pos") + F.col("pos_above"), F.col("neg") + F.col("neg_above")
    share = lambda a, b: ratio(a.cast("double"), b.cast("double"))
    return made.crossJoin(total).select(score, share(tp, tp + fp).alias("precision"), share(tp, F.col("__p")).alias("recall"), share(F.col("pos"), F.col("__p")).alias("step"))


def mcnemar(rows: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """Discordant counts, the continuity-corrected statistic (|b - c| - 1)^2 / (b + c), 0 where nothing is discordant, and its p-value."""
    right = lambda c: F.col(c) == F.col(truth)
    made = rows.agg(F.count_if(right(a) & ~right(b)).alias("b"), F.count_if(~right(a) & right(b)).alias("c"))
    gap = F.abs(F.col("b") - F.col("c")) - 1
    made = made.withColumn("statistic", F.coalesce(ratio((gap * gap).cast("double"), (F.col("b") + F.col("c")).cast("double")), F.lit(0.0)))
    return made.withColumn("p_value", _chi2_tail(F.col("statistic")))


@F.pandas_udf(T.DoubleType())
def _chi2_tail(x: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution with one degree of freedom (a row or a few)."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)))


def split_groups(rows: DataFrame, group: str, label: str, test: float = 0.2, validation: float = 0.2, seed: int = 7) -> DataFrame:
    """Every group whole in train, validation or test, by class: groups are ranked by a hash and cut at rounded quotas.

    Groups are numbered inside ranges of the hash (four digits, 65,536 at most), on top of the counts of the ranges before.
    """
    hashed = rows.groupBy(group).agg(F.max(label).alias("class")).withColumn("__h", F.md5(F.concat_ws(":", F.col(group).cast("string"), F.lit(str(seed))))).withColumn("__range", F.substring("__h", 1, 4))
    counts = hashed.groupBy("class", "__range").agg(F.count("*").alias("__c"))
    over = Window.partitionBy("class")
    before = counts.select("class", "__range", F.coalesce(F.sum("__c").over(over.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__c").over(over).alias("n"))
    numbered = hashed.withColumn("__k", F.row_number().over(Window.partitionBy("class", "__range").orderBy("__h", group)))
    ranked = numbered.join(before, (numbered["class"].eqNullSafe(before["class"])) & (numbered["__range"] == before["__range"])).drop(before["class"]).withColumn("k", F.col("__before") + F.col("__k"))
    n_test, n_val = F.floor(F.col("n") * test + 0.5), F.floor(F.col("n") * validation + 0.5)
    part = F.when(F.col("k") <= n_test, "test").when(F.col("k") <= n_test + n_val, "validation").otherwise("train")
    return ranked.select(group, "class", part.alias("part"))


def bootstrap_accuracy(rows: DataFrame, truth: str, predicted: str, resamples: int = 2000, seed: int = 11) -> DataFrame:
    """2.5, 50 and 97.5 % points of the balanced accuracy over resamples with replacement.

    A resample matters by its four cell counts alone, which are multinomial: the rows are counted once, and draws made from the counts.
    """
    cell = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(predicted) == p)).cast("double")
    counts = rows.agg(F.array(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1)).alias("cells"))
    draws = counts.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).repartition(8, "b")

    def draw(frames):
        for pdf in frames:
            out = []
            for cells, b in zip(pdf["cells"], pdf["b"], strict=True):
                n = np.asarray(cells).sum()
                c = np.random.default_rng((seed, int(b))).multinomial(int(n), np.asarray(cells) / n) if n else np.zeros(4)
                out.append((c[0] / (c[0] + c[1]) + c[3] / (c[2] + c[3])) / 2 if c[0] + c[1] > 0 and c[2] + c[3] > 0 else None)
            yield pd.DataFrame({"v": pd.array(out, dtype="Float64")})

    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return draws.mapInPandas(draw, "v double").agg(q.alias("q"), F.count("v").alias("resamples")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"), "resamples")


def bootstrap_auc(rows: DataFrame, truth: str, score: str, resamples: int = 2000, seed: int = 11, ranges: int = RANGES, block: int = 256) -> DataFrame:
    """2.5, 50 and 97.5 % points of the area under the curve over resamples of the rows with replacement (those with one class count for nothing).

    A resample matters by how often each score and class is drawn, which is multinomial: rows are counted once by score. The draws of all resamples are first dealt to
    ranges of scores (resamples x ranges numbers on the driver), then inside each range, a block of scores at a time, by what of the range is
    left; so no task holds more than resamples x block draws. Each range sums its own part of the area, and the ranges are cumulated for all resamples together.
    """
    known = rows.filter(F.col(truth).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    counted = keep(known.groupBy(F.col(score).cast("double").alias("v")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")), "scores")
    cuts = _cuts(counted, "v", ranges)
    ranged = counted.withColumn("part", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("v"))) if cuts else F.lit(0))
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum(F.col("pos") + F.col("neg")).alias("n")).collect()}
    parts = sorted(sizes)
    n = sum(sizes.values())
    dealt = np.random.default_rng(seed).multinomial(n, [sizes[p] / n for p in parts], size=resamples) if n else np.zeros((resamples, 0), dtype=np.int64)
    draws_of = {p: dealt[:, i] for i, p in enumerate(parts)}

    def areas(frames):
        now, rng, left, rest, pos, neg, won = None, None, None, 0, None, None, None

        def out():
            return pd.DataFrame({"part": [now], "p": [pos], "n": [neg], "w": [won]})

        for pdf in frames:
            for lo in range(0, len(pdf), block):
                for part, chunk in pdf[lo : lo + block].groupby("part", sort=False):
                    if part != now:
                        if now is not None:
                            yield out()
                        now, rng, left, rest = part, np.random.default_rng((seed, int(part))), draws_of[part].copy(), sizes[part]
                        pos, neg, won = np.zeros(resamples), np.zeros(resamples), np.zeros(resamples)
                    cells = np.concatenate([chunk["pos"].to_numpy(), chunk["neg"].to_numpy()]).astype(float)
                    here = left if cells.sum() >= rest else rng.binomial(left, cells.sum() / rest)
                    left, rest = left - here, rest - int(cells.sum())
                    drawn = rng.multinomial(here, cells / cells.sum())
                    p, q = drawn[:, : len(chunk)], drawn[:, len(chunk) :]  # highest score first
                    above = np.cumsum(p, axis=1) - p + pos[:, None]
                    won += (q * (above + p / 2)).sum(1)
                    pos, neg = pos + p.sum(1), neg + q.sum(1)
        if now is not None:
            yield out()

    sorted_ = ranged.repartition("part").sortWithinPartitions("part", F.desc("v"))
    made = sorted_.mapInPandas(areas, "part int, p array<double>, n array<double>, w array<double>")
    each = made.select("part", F.posexplode(F.arrays_zip("p", "n", "w")).alias("b", "s")).select("part", "b", "s.p", "s.n", "s.w")
    above = F.coalesce(F.sum("p").over(Window.partitionBy("b").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    auc = each.withColumn("w", F.col("w") + F.col("n") * above).groupBy("b").agg(ratio(F.sum("w"), F.sum("p") * F.sum("n")).alias("v"))
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))  # over the resamples
    return auc.agg(q.alias("q"), F.count("v").alias("resamples")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"), "resamples")


def wilcoxon(rows: DataFrame, a: str, b: str, alternative: str = "two-sided", digits: int = 12) -> DataFrame:
    """Signed-rank test of a - b over pairs: n (without zeros), rank sums plus and minus, statistic, z (with the tie correction) and p_value.

    Differences are rounded to digits, so that equal ones tie; tied magnitudes share their mean rank. Up to 50 pairs without ties or zeros the tail is exact, by counting the
    subsets of ranks with each sum; else it is normal. Pairs with a null or NaN take no part; without pairs statistic 0 and p_value 1.
    Magnitudes are counted first and ranked over ranges side by side, so no task ranks all pairs.
    """
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError("the alternative is two-sided, greater or less")
    d = F.round(F.col(a).cast("double") - F.col(b).cast("double"), digits)
    known = rows.select(d.alias("d")).filter(F.col("d").isNotNull() & ~F.isnan("d"))
    zeros = known.agg(F.count_if(F.col("d") == 0).alias("zeros"))
    signed = known.filter("d <> 0").select((F.col("d") > 0).cast("int").alias("up"), F.abs("d").alias("size"))
    counted = _cumulated(signed, "up", "size").withColumn("t", F.col("pos") + F.col("neg")).withColumn("above", F.col("pos_above") + F.col("neg_above"))
    # the rank from below is n less what lies above; n is put in at the end
    sums = counted.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.coalesce(F.sum("pos"), F.lit(0)).alias("__p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("__m"),
        F.coalesce(F.sum(F.col("pos") * (F.col("above") + (F.col("t") - 1) / 2)), F.lit(0.0)).alias("__pa"), F.coalesce(F.sum(F.col("neg") * (F.col("above") + (F.col("t") - 1) / 2)), F.lit(0.0)).alias("__ma"),
        F.coalesce(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")), F.lit(0.0)).alias("ties"),
    ).crossJoin(zeros)  # one row each
    made = sums.select("n", "zeros", "ties", (F.col("__p") * F.col("n") - F.col("__pa")).alias("plus"), (F.col("__m") * F.col("n") - F.col("__ma")).alias("minus"))
    statistic = F.least("plus", "minus") if alternative == "two-sided" else F.col("plus")
    n = F.col("n").cast("double")
    made = made.withColumn("statistic", statistic).withColumn("z", ratio(F.col("statistic") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)))
    tail = F.pandas_udf(lambda n, zeros, ties, s, z: pd.Series([_rank_tail(*v, alternative) for v in zip(n, zeros, ties, s, z, strict=True)]), T.DoubleType())  # one row
    return made.withColumn("p_value", tail("n", "zeros", "ties", "statistic", F.coalesce("z", F.lit(0.0)))).drop("zeros", "ties")


def rank_sum_counts(n: int) -> list[int]:
    """How many subsets of the ranks 1 to n have each sum."""
    counts = [1]
    for rank in range(1, n + 1):
        counts = [(counts[s] if s < len(counts) else 0) + (counts[s - rank] if s >= rank else 0) for s in range(len(counts) + rank)]
    return counts


def _rank_tail(n: int, zeros: int, ties: float, s: float, z: float, alternative: str) -> float:
    if not n:
        return 1.0
    if n <= 50 and not zeros and not ties:
        counts = rank_sum_counts(int(n))
        if alternative == "greater":
            return sum(counts[int(s) :]) / 2**n
        low = sum(counts[: int(s) + 1]) / 2**n
        return low if alternative == "less" else min(1.0, 2 * low)
    if alternative == "greater":
        return math.erfc(z / math.sqrt(2)) / 2
    return math.erfc(-z / math.sqrt(2)) / 2 if alternative == "less" else math.erfc(abs(z) / math.sqrt(2))
