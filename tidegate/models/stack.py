"""Stacked detector: forest and one-class probabilities under a logistic meta-learner.

`leave_out_scores` makes the fits of `fit_stack` for several held-out categories together: each step is one pass over the
rows of all rounds, which a column of round numbers keeps apart.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.config import Config
from tidegate.functions.numbers import doubles, logistic
from tidegate.models.forest import (
    RandomForest, fit_random_forest, fit_random_forests, fold_macro_f1, forest_cv_score, mean_shares, score_forest,
)
from tidegate.models.linear import LogisticTask, grouped_logistic_fits, linear, logistic_fits
from tidegate.models.oneclass import OneClassSvm, fit_one_class, search_detector
from tidegate.operators.metrics import add_rates, confusion_counts, roc_auc
from tidegate.operators.sampling import stratified_folds, subsample_rows
from tidegate.session import fit_input, stage

STACK_INPUTS = ["p_supervised", "p_anomaly"]
#: Rows that one task scores with all forests, at most and, while cores are free, at least.
SCORED_ROWS, LEAST_SCORED_ROWS = 20_000, 1_000


@dataclass(frozen=True)
class StackedDetector:
    supervised: RandomForest
    anomaly: OneClassSvm
    meta_weights: list[float]
    meta_intercept: float
    params: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, output: str = "p") -> DataFrame:
        """Adds the attack probability; only narrow operations, so it also runs on streams."""
        stacked = base_probabilities(df, self.supervised, self.anomaly)
        score = linear(STACK_INPUTS, [*self.meta_weights, self.meta_intercept])
        return stacked.withColumn(output, logistic(score)).drop(*STACK_INPUTS)


def base_probabilities(df: DataFrame, supervised, anomaly: OneClassSvm) -> DataFrame:
    return anomaly.transform(score_forest(supervised, df, "p_supervised"), "p_anomaly")


def benign_detectors(train: DataFrame, config: Config) -> list[OneClassSvm]:
    """Uncalibrated detectors for every nu, from benign training rows only."""
    models = config.models
    benign = train.filter("y = 0").select("row_id", "features")
    capped = subsample_rows(benign, models.max_benign_rows, config.seed, key=["row_id"])
    return fit_one_class(capped, models.nu_grid, models.one_class_iterations)


def meta_scores(stacked: DataFrame, grid: Sequence[float], seed: int, max_iter: int, folds: int = 3) -> dict[float, float]:
    """Cross-validated macro-F1 per regularisation strength; expects row_id, y and the stack inputs."""
    with fit_input(stratified_folds(stacked.select("row_id", "y", *STACK_INPUTS), folds, seed, key=["row_id"])) as split:
        tasks = [LogisticTask(STACK_INPUTS, c, f"fold <> {fold}") for c in grid for fold in range(folds)]
        fits = iter(logistic_fits(split, tasks, max_iter))
        scores = {}
        for c in grid:
            p = F.lit(None).cast("double")
            for fold in range(folds):
                weights, intercept = next(fits)
                value = logistic(linear(STACK_INPUTS, [*weights, intercept]))
                p = F.when(F.col("fold") == fold, value).otherwise(p)
            scores[c] = fold_macro_f1(split.select("fold", "y", (p > 0.5).cast("int").alias("yhat")))
        return scores


def fit_stack(
    train: DataFrame, validation: DataFrame, config: Config = Config(),
    detectors: list[OneClassSvm] | None = None, diagnose: bool = False,
) -> StackedDetector:
    """Forest on balanced training rows, detector on benign rows, meta-learner on validation rows.

    Frames have row_id, features, y. `detectors` may be shared between fits whose benign rows agree.
    """
    models = config.models
    supervised = fit_random_forest(train, models.forest_trees, models.forest_depth, config.seed)
    params = {"n_estimators": models.forest_trees, "max_depth": models.forest_depth}
    if diagnose:
        params["forest_cv_macro_f1"] = forest_cv_score(
            train, models.forest_trees, models.forest_depth, config.seed, models.forest_cv_rows)
    anomaly, area = search_detector(detectors or benign_detectors(train, config), validation)
    with fit_input(base_probabilities(validation, supervised, anomaly).select("row_id", "y", *STACK_INPUTS)) as stacked:
        scores = meta_scores(stacked, models.meta_c_grid, config.seed, models.meta_max_iter)
        best = max(models.meta_c_grid, key=lambda c: (scores[c], -list(models.meta_c_grid).index(c)))
        (weights, intercept), = logistic_fits(stacked, [LogisticTask(STACK_INPUTS, best)], models.meta_max_iter)
    params.update(nu=anomaly.nu, anomaly_auc=area, meta_c=best, meta_macro_f1=scores[best])
    return StackedDetector(supervised, anomaly, weights, intercept, params)


def leave_out_scores(
    train: DataFrame, validation: DataFrame, test: DataFrame, held_out: Sequence[str], config: Config = Config()
) -> DataFrame:
    """Test rows (held_out_category, category, y, p) scored by a stack for each category, fitted without its rows.

    Frames have row_id, features, y, category. Benign rows are the same in every round, so the detectors are fitted once.
    """
    models = config.models
    detectors = benign_detectors(train, config)
    forests = fit_random_forests(train, held_out, models.forest_trees, models.forest_depth, config.seed)
    scored = stage(_base_scores(validation, test, forests, detectors), "loaco-scores")
    names = F.array(*[F.lit(category) for category in held_out])
    long = scored.select("_fit", "row_id", "category", "y", "_s", F.posexplode("_p").alias("_round", "p_supervised"))
    long = long.withColumn("held_out_category", names[F.col("_round")])
    seen = long.filter(F.col("_fit") & (F.col("category") != F.col("held_out_category")))
    with fit_input(seen.select("_round", "row_id", "y", "p_supervised", "_s")) as rows:
        anomaly = _search_rounds(rows, len(detectors), len(held_out))
        stacked = rows.select("_round", "row_id", "y", "p_supervised", anomaly.alias("p_anomaly"))
        points = _meta_rounds(stacked, len(held_out), config)
    p = logistic(linear(STACK_INPUTS, points, "_round"))
    return long.filter(~F.col("_fit")).withColumn("p_anomaly", anomaly).select("held_out_category", "category", "y", p.alias("p"))


def _base_scores(validation: DataFrame, test: DataFrame, forests: list[RandomForest], detectors: list[OneClassSvm]) -> DataFrame:
    """row_id, category, y, whether a row is for validation (_fit), the shares of all forests (_p), raw scores of the detectors (_s)."""
    columns = ["row_id", "category", "y", "features"]
    rows = validation.select(*columns, F.lit(True).alias("_fit")).unionByName(test.select(*columns, F.lit(False).alias("_fit")))
    count = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(count / SCORED_ROWS), min(cores, math.ceil(count / LEAST_SCORED_ROWS)))
    scored = rows.repartition(parts).withColumn("_x", vector_to_array("features"))
    return scored.select("_fit", "row_id", "category", "y", mean_shares(forests).alias("_p"),
                         F.array(*[d.anomaly() for d in detectors]).alias("_s"))


def _search_rounds(rows: DataFrame, detectors: int, rounds: int) -> Column:
    """Probability of the detector that has the best ROC-AUC in the row's round, as `search_detector` finds it."""
    names = [f"s{i}" for i in range(detectors)]
    scored = rows.select("_round", "y", *[F.col("_s")[i].alias(n) for i, n in enumerate(names)])
    fits = grouped_logistic_fits(scored, [LogisticTask([n], 1.0) for n in names], rounds, "_round")
    points = [[(slope[0], intercept) for slope, intercept in fit] for fit in fits]
    entries = [F.struct(F.lit(i).alias("model"), _sigmoid(n, [fit[i] for fit in points]).alias("p")) for i, n in enumerate(names)]
    areas = {(r._round, r.model): r.roc_auc for r in roc_auc(
        scored.select("_round", "y", F.inline(F.array(*entries))), ["_round", "model"]).collect()}
    best = [max(range(detectors), key=lambda i: (areas[g, i], -i)) for g in range(rounds)]
    chosen = F.col("_s")[F.array(*[F.lit(i) for i in best])[F.col("_round")]]
    return _sigmoid(chosen, [fit[i] for fit, i in zip(points, best, strict=True)])


def _sigmoid(score: str | Column, points: Sequence[tuple[float, float]]) -> Column:
    """Calibrated score by (slope, intercept) of the row's round."""
    slope, intercept = (F.expr(doubles(values))[F.col("_round")] for values in zip(*points, strict=True))
    return logistic(slope * (F.col(score) if isinstance(score, str) else score) + intercept)


def _meta_rounds(stacked: DataFrame, rounds: int, config: Config, folds: int = 3) -> list[list[float]]:
    """Weights and intercept of the meta-learner of every round, its strength chosen as `meta_scores` and `fit_stack` do."""
    grid, iterations = config.models.meta_c_grid, config.models.meta_max_iter
    with fit_input(stratified_folds(stacked, folds, config.seed, ["_round", "y"], ["row_id"])) as split:
        tasks = [LogisticTask(STACK_INPUTS, c, where) for c in grid for where in (*[f"fold <> {k}" for k in range(folds)], "true")]
        fits = [[[*weights, intercept] for weights, intercept in fit]
                for fit in grouped_logistic_fits(split, tasks, rounds, "_round", iterations)]
        entries = []
        for i, c in enumerate(grid):
            # points in the order of (round, fold)
            points = [point for fit in fits for point in fit[i * (folds + 1) : (i + 1) * (folds + 1) - 1]]
            p = logistic(linear(STACK_INPUTS, points, f"_round * {folds} + fold"))
            entries.append(F.struct(F.lit(i).alias("_c"), (p > 0.5).cast("int").alias("yhat")))
        by = ["_round", "_c"]
        table = confusion_counts(split.select("_round", "fold", "y", F.inline(F.array(*entries))), [*by, "fold"])
        means = add_rates(table, ["macro_f1"]).groupBy(*by).agg(F.avg("macro_f1").alias("score")).collect()
    scores = {(r._round, r._c): r.score for r in means}
    best = [max(range(len(grid)), key=lambda i: (scores[g, i], -i)) for g in range(rounds)]
    return [fit[(i + 1) * (folds + 1) - 1] for fit, i in zip(fits, best, strict=True)]
