"""Detectors over feature tables: grouped cross-validation without leakage, probabilities, isotonic calibration."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.operators.detection import confusion
from tremor.operators.tables import keep


def models(seed: int = 7) -> dict:
    """The learners at hand. The margin classifier is linear; for one with a radial kernel and calibrated probabilities see calibrated_margins."""
    return {
        "logistic": LogisticRegression(labelCol="label", weightCol="weight", maxIter=50),
        "forest": RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=50, seed=seed),
        "boosted": GBTClassifier(labelCol="label", weightCol="weight", maxIter=20, seed=seed),
        "margin": LinearSVC(labelCol="label", weightCol="weight", maxIter=50),
    }


def prepared(rows: DataFrame, features: list[str], label: str, group: str, folds: int) -> DataFrame:
    """Complete rows with balanced class weights and a fold per group; a group never spans two folds. Every fold and step of a fit reads these rows, so they are made once."""
    complete = keep(rows.dropna(subset=[*features, label]).select(*features, F.col(label).cast("double").alias("label"), F.col(group).alias("group")), "complete")
    counts = complete.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    weights = counts.crossJoin(total).select("label", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))  # a row per class
    return complete.join(F.broadcast(weights), "label").withColumn("fold", F.pmod(F.xxhash64("group"), F.lit(folds)).cast("int"))


def grouped_predictions(rows: DataFrame, features: list[str], label: str, group: str, model: str = "logistic", folds: int = 5) -> DataFrame:
    """Out-of-fold class and probability of each complete row; scaling is learned on the training folds only."""
    data = prepared(rows, features, label, group, folds)
    parts = []
    for k in range(folds):
        train, test = data.filter(F.col("fold") != k), data.filter(F.col("fold") == k)
        if train.select("label").distinct().count() < 2:
            continue
        chain = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), models()[model]])
        scored = chain.fit(train).transform(test)
        score = vector_to_array("probability")[1] if "probability" in scored.columns else vector_to_array("rawPrediction")[1]
        parts.append(scored.select("group", "fold", "label", F.col("prediction").cast("int").alias("predicted"), score.alias("score")))
    if not parts:
        raise ValueError("no fold has two classes to learn from")
    return reduce(DataFrame.union, parts)


def radial_features(x: Column, size: int, dims: int = 256, gamma: float | None = None, seed: int = 7) -> Column:
    """Random Fourier features of arrays of `size` numbers: their products come near the radial kernel exp(-gamma |x - y|^2). gamma: 1 / size, which suits scaled features."""
    rng = np.random.default_rng(seed)
    turns = rng.normal(scale=np.sqrt(2 * (gamma or 1 / size)), size=(size, dims))
    start = rng.uniform(0, 2 * np.pi, dims)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def made(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.cos(np.stack(values.to_numpy()) @ turns + start) * np.sqrt(2 / dims)))

    return made(x)


def calibrated_margins(rows: DataFrame, features: list[str], label: str, group: str, folds: int = 5, dims: int = 256, iterations: int = 50, most_inner: int = 3, seed: int = 7) -> DataFrame:
    """Out-of-fold (group, fold, label, predicted, score) of a margin classifier on radial features (dims 0: on the features themselves), with probabilities.

    The probability is a logistic curve of the margin, fitted on margins of inner folds of the training rows: as many as most_inner, but no more than the smaller class has
    rows. Groups are whole in inner folds too. With fewer than two inner folds the margin's own logistic value is the score. Folds that lack a class for training are left out.
    """
    data = prepared(rows, features, label, group, folds)
    size = len(features)
    values = lambda df: df.withColumn("x", array_to_vector(radial_features(vector_to_array("scaled"), size, dims, seed=seed)) if dims else F.col("scaled"))
    learner = LinearSVC(featuresCol="x", labelCol="label", weightCol="weight", maxIter=iterations)
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    parts = []
    for k in range(folds):
        train, test = data.filter(F.col("fold") != k), data.filter(F.col("fold") == k)
        counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
        if len(counts) < 2 or test.isEmpty():
            continue
        scaler = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)]).fit(train)
        known = keep(values(scaler.transform(train)).select("group", "label", "weight", "x", F.xxhash64("group", F.lit(seed)).alias("h")), "training")
        inner = min(most_inner, int(min(counts.values())))
        held = []
        for j in range(inner if inner > 1 else 0):
            rest, part = known.filter(F.pmod("h", F.lit(inner)) != j), known.filter(F.pmod("h", F.lit(inner)) == j)
            if rest.select("label").distinct().count() == 2 and not part.isEmpty():
                held.append(learner.fit(rest).transform(part).select("label", margin))
        scored = learner.fit(known).transform(values(scaler.transform(test))).select("group", "fold", "label", margin)
        curve = (1.0, 0.0)
        if held:
            seen = keep(reduce(DataFrame.union, held), "margins")
            if seen.select("label").distinct().count() == 2:
                fitted = LogisticRegression(labelCol="label", maxIter=50).fit(VectorAssembler(inputCols=["margin"], outputCol="features").transform(seen))
                curve = (float(fitted.coefficients[0]), float(fitted.intercept))
        score = 1 / (1 + F.exp(-(F.col("margin") * curve[0] + curve[1])))
        parts.append(scored.select("group", "fold", "label", (score >= 0.5).cast("int").alias("predicted"), score.alias("score")))
    if not parts:
        raise ValueError("no fold has two classes to learn from")
    return reduce(DataFrame.union, parts)


def fold_metrics(predictions: DataFrame) -> DataFrame:
    return confusion(predictions, "label", "predicted", ["fold"])


def calibration(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Steps of the isotonic fit of label on score: boundary and calibrated value."""
    model = IsotonicRegression(featuresCol="score", labelCol="label").fit(rows.select(F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("label")).dropna())
    steps = zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist(), strict=True)
    return rows.sparkSession.createDataFrame([(float(b), float(min(1.0, max(0.0, p)))) for b, p in steps], "boundary double, calibrated double")
