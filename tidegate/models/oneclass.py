"""Linear one-class support vector machine and its calibration.

The dual looks for the shortest mean w of benign rows in which no row weighs more than 1/(nu*n).
Given w, the steepest descent direction is the mean of the nu*n rows with the smallest w.x, so a
conditional-gradient step needs one quantile and one conditional mean: two aggregates per round
for all values of nu together. rho is the nu-quantile of w.x at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.functions.numbers import array_dot, dot, logistic
from tidegate.models.linear import LogisticTask, logistic_fits, with_array
from tidegate.operators.metrics import roc_auc
from tidegate.session import fit_input

QUANTILE_ACCURACY = 1000
CLIP = 1e-6


@dataclass(frozen=True)
class OneClassSvm:
    nu: float
    weights: list[float]
    rho: float
    method: str | None = None
    slope: float = 0.0
    intercept: float = 0.0
    isotonic: IsotonicRegressionModel | None = None

    def anomaly(self, array: str = "_x") -> Column:
        """rho - w.x over an array column: positive outside the benign region."""
        return F.lit(self.rho) - dot(array, self.weights)

    def transform(self, df: DataFrame, output: str = "p") -> DataFrame:
        if self.method is None:
            raise RuntimeError("calibrate the detector before asking for probabilities")
        scored = with_array(df).withColumn("_s", self.anomaly()).drop("_x")
        if self.method == "sigmoid":
            return scored.withColumn(output, logistic(F.lit(self.slope) * F.col("_s") + F.lit(self.intercept))).drop("_s")
        scored = self.isotonic.transform(scored)
        clipped = F.greatest(F.least(F.col("_iso"), F.lit(1.0 - CLIP)), F.lit(CLIP))
        return scored.withColumn(output, clipped).drop("_s", "_iso")


def fit_one_class(benign: DataFrame, nus: Sequence[float], iterations: int = 60, tolerance: float = 1e-6) -> list[OneClassSvm]:
    """One detector per nu, fitted side by side on benign rows with column features."""
    with fit_input(benign.select("features", vector_to_array("features").alias("x"))) as rows:
        start = rows.agg(Summarizer.mean(F.col("features")).alias("m")).first().m.toArray()
        weights = [start.copy() for _ in nus]
        done = [False] * len(nus)
        for _ in range(iterations):
            cuts = _quantiles(rows, weights, nus)
            for i, target in enumerate(_lowest_means(rows, weights, cuts)):
                gap = weights[i] - target
                length = float(gap @ gap)
                gain = float(weights[i] @ gap)
                done[i] = done[i] or length == 0.0 or gain <= tolerance * max(float(weights[i] @ weights[i]), 1e-300)
                if not done[i]:
                    weights[i] = weights[i] - min(1.0, gain / length) * gap
            if all(done):
                break
        cuts = _quantiles(rows, weights, nus)
    return [OneClassSvm(float(nu), [float(v) for v in w], float(rho)) for nu, w, rho in zip(nus, weights, cuts, strict=True)]


def _scores(rows: DataFrame, weights) -> DataFrame:
    return rows.select("features", *[array_dot("x", w).alias(f"s{i}") for i, w in enumerate(weights)])


def _quantiles(rows: DataFrame, weights, nus) -> list[float]:
    cells = [F.percentile_approx(f"s{i}", F.lit(float(nu)), QUANTILE_ACCURACY) for i, nu in enumerate(nus)]
    return list(_scores(rows, weights).agg(F.array(*cells).alias("q")).first().q)


def _lowest_means(rows: DataFrame, weights, cuts) -> list[np.ndarray]:
    low = [F.when(F.col(f"s{i}") <= F.lit(float(cut)), 1.0).otherwise(0.0) for i, cut in enumerate(cuts)]
    means = [Summarizer.mean(F.col("features"), w).alias(f"m{i}") for i, w in enumerate(low)]
    return [m.toArray() for m in _scores(rows, weights).agg(*means).first()]


def calibrate(detector: OneClassSvm, validation: DataFrame, method: str = "sigmoid") -> OneClassSvm:
    """Maps the anomaly score to a probability on labelled rows with features and y."""
    if method == "sigmoid":
        return calibrate_sigmoid([detector], validation)[0]
    if method == "isotonic":
        scored = with_array(validation).select(detector.anomaly().alias("_s"), F.col("y").cast("double").alias("y"))
        model = IsotonicRegression(featuresCol="_s", labelCol="y", predictionCol="_iso").fit(scored)
        return replace(detector, method=method, isotonic=model)
    raise ValueError(f"unknown calibration method {method!r}")


def calibrate_sigmoid(detectors: Sequence[OneClassSvm], validation: DataFrame) -> list[OneClassSvm]:
    """Ridge logistic calibration (C = 1) of several detectors in common passes."""
    names = [f"s{i}" for i in range(len(detectors))]
    scored = with_array(validation).select("y", *[d.anomaly().alias(n) for d, n in zip(detectors, names, strict=True)])
    fits = logistic_fits(scored, [LogisticTask([n], 1.0) for n in names])
    return [replace(d, method="sigmoid", slope=slope[0], intercept=intercept)
            for d, (slope, intercept) in zip(detectors, fits, strict=True)]


def search_detector(detectors: Sequence[OneClassSvm], validation: DataFrame) -> tuple[OneClassSvm, float]:
    """The detector with the best ROC-AUC on the validation rows after sigmoid calibration.

    All candidates are scored in one frame; among equals the first one wins.
    """
    fitted = calibrate_sigmoid(detectors, validation)
    entries = []
    for i, d in enumerate(fitted):
        p = logistic(F.lit(d.slope) * d.anomaly() + F.lit(d.intercept))
        entries.append(F.struct(F.lit(i).alias("model"), p.alias("p")))
    long = with_array(validation).select("y", F.inline(F.array(*entries)))
    areas = {row.model: row.roc_auc for row in roc_auc(long, ["model"]).collect()}
    best = max(range(len(fitted)), key=lambda i: (areas[i], -i))
    return fitted[best], float(areas[best])
