"""Fitting, storing and scoring the three models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.config import Config
from tidegate.functions.decision import at_least
from tidegate.models.features import FeaturePipeline
from tidegate.models.forest import load_random_forest, save_random_forest
from tidegate.models.isolation import IsolationForest, fit_isolation_forest, load_forest, save_forest, scale_scores
from tidegate.models.linear import CalibratedSvc, fit_linear_svc
from tidegate.models.oneclass import OneClassSvm
from tidegate.models.stack import StackedDetector, fit_stack

MODEL_NAMES = ["LinearSVC", "IsolationForest", "Stack"]


@dataclass(frozen=True)
class Models:
    svc: CalibratedSvc
    isolation: IsolationForest
    stack: StackedDetector


def part(splits: DataFrame, name: str) -> DataFrame:
    return splits.filter(F.col("split") == name).drop("split")


def train_all(splits: DataFrame, config: Config = Config()) -> Models:
    train, validation, options = part(splits, "train"), part(splits, "val"), config.models
    svc = fit_linear_svc(train, options.svc_c, options.svc_max_iter, config.seed)
    isolation = fit_isolation_forest(
        train.filter("y = 0"), options.isolation_trees, options.isolation_sample, options.isolation_max_rows, config.seed)
    return Models(svc, isolation, fit_stack(train, validation, config))


def training_summary(splits: DataFrame, models: Models) -> DataFrame:
    sizes = splits.groupBy("split").agg(F.count(F.lit(1)).cast("string").alias("value"))
    params = splits.sparkSession.createDataFrame(
        [(k, str(v)) for k, v in sorted(models.stack.params.items())], "item string, value string")
    return sizes.select(F.concat(F.col("split"), F.lit(" rows")).alias("item"), "value").unionByName(params)


def predictions(models: Models, test: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Long predictions (model, row_id, category, y, yhat, p) of all three models."""
    keep = ["row_id", "category", "y"]
    flag = at_least(F.col("p"), threshold).cast("int").alias("yhat")
    scored = {
        "LinearSVC": models.svc.transform(test).select(*keep, flag, "p"),
        "IsolationForest": scale_scores(models.isolation.transform(test)).select(*keep, "yhat", "p"),
        "Stack": models.stack.transform(test).select(*keep, flag, "p"),
    }
    table = None
    for name, frame in scored.items():
        named = frame.select(F.lit(name).alias("model"), *keep, "yhat", "p")
        table = named if table is None else table.unionByName(named)
    return table


def scorer(pipeline: FeaturePipeline, stack: StackedDetector):
    """Scores frames of flow features, in batch or on a stream."""
    def score(features: DataFrame) -> DataFrame:
        return stack.transform(pipeline.transform(features), "model_proba")

    return score


def save_models(models: Models, spark: SparkSession, path: str) -> None:
    """Folders forest, isolation, stack, svc and, for a detector calibrated so, isotonic."""
    stack = models.stack
    save_random_forest(stack.supervised, spark, f"{path}/forest")
    save_forest(models.isolation, spark, f"{path}/isolation")
    anomaly = stack.anomaly
    if anomaly.isotonic is not None:
        anomaly.isotonic.write().overwrite().save(f"{path}/isotonic")
    spark.createDataFrame(
        [(anomaly.nu, anomaly.weights, anomaly.rho, anomaly.method, anomaly.slope, anomaly.intercept,
          stack.meta_weights, stack.meta_intercept, {k: str(v) for k, v in stack.params.items()})],
        "nu double, weights array<double>, rho double, method string, slope double, intercept double, "
        "meta_weights array<double>, meta_intercept double, params map<string,string>",
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/stack")
    spark.createDataFrame(
        models.svc.members, "weights array<double>, bias double, slope double, intercept double",
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/svc")


def load_models(spark: SparkSession, path: str) -> Models:
    s = spark.read.parquet(f"{path}/stack").first()
    isotonic = IsotonicRegressionModel.load(f"{path}/isotonic") if s.method == "isotonic" else None
    anomaly = OneClassSvm(s.nu, list(s.weights), s.rho, s.method, s.slope, s.intercept, isotonic)
    stack = StackedDetector(load_random_forest(spark, f"{path}/forest"), anomaly,
                            list(s.meta_weights), s.meta_intercept, dict(s.params))
    members = [(list(r.weights), r.bias, r.slope, r.intercept) for r in spark.read.parquet(f"{path}/svc").collect()]
    return Models(CalibratedSvc(members), load_forest(spark, f"{path}/isolation"), stack)
