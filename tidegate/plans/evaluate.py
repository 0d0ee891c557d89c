"""Held-out evaluation and the leave-one-category-out experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegate.config import Config
from tidegate.functions.decision import at_least
from tidegate.models.stack import fit_stack, leave_out_scores
from tidegate.operators import metrics as M
from tidegate.operators.cleaning import mask_category
from tidegate.plans.preprocess import preprocess, split_table
from tidegate.plans.train import MODEL_NAMES, Models, part, predictions
from tidegate.session import stage


def evaluate(splits: DataFrame, models: Models, config: Config = Config()) -> dict[str, DataFrame]:
    """All result tables of the test split, from one staged table of predictions."""
    scored = stage(predictions(models, part(splits, "test"), config.threshold), "predictions")
    recalls, counts = M.per_category_recall(scored), M.score_counts(scored)
    return {
        "metrics_summary": M.evaluate_counts(counts),
        "per_category_recall": M.recall_pivot(recalls, sorted(MODEL_NAMES)),
        "confusion": M.confusion_counts(scored),
        "reliability": M.reliability_curve(scored),
        "pr_curve": M.curve_of_counts(counts),
    }


def loaco(splits: DataFrame, config: Config = Config(), prepared: DataFrame | None = None) -> DataFrame:
    """One row per held-out category: the stack is refitted without it and tested on all rows.

    By default features and synthetic rows are those of `splits`, which saw the category. Given the
    prepared table, the feature pipeline is refitted without the category as well.
    """
    if not config.loaco.enabled:
        raise ValueError("the leave-one-category-out experiment is switched off")
    train, validation, test = (part(splits, n) for n in ("train", "val", "test"))
    checked = M.loaco_categories(train, config.loaco.categories).filter("present").orderBy("position")
    categories = [row.category for row in checked.collect()]
    if not categories:
        raise ValueError("no configured category occurs in the training rows")
    flag = at_least(F.col("p"), config.threshold).cast("int").alias("yhat")
    columns = ["held_out_category", "category", "y", flag]
    if prepared is None:
        return M.loaco_metrics(leave_out_scores(train, validation, test, categories, config).select(*columns))
    results = None
    for held_out in categories:
        rows = _refitted(prepared, held_out, config)
        model = fit_stack(mask_category(rows[0], held_out), mask_category(rows[1], held_out), config)
        scored = model.transform(rows[2]).withColumn("held_out_category", F.lit(held_out)).select(*columns)
        scored = stage(scored, "loaco")
        results = scored if results is None else results.unionByName(scored)
    return M.loaco_metrics(results)


def _refitted(prepared: DataFrame, held_out: str, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Splits whose pipeline and balancing never saw the category; test rows keep it."""
    rows, _ = split_table(prepared, config)
    seen = stage(rows.filter((F.col("category") != held_out) | (F.col("split") == "test")), "refit")
    from tidegate.models.features import fit_feature_pipeline
    from tidegate.plans.preprocess import balance

    names = [c for c in seen.columns if c not in ("row_id", "y", "category", "split")]
    options = config.preprocess
    pipeline = fit_feature_pipeline(seen.filter("split = 'train'"), names, options.rfe_features, options.pca_variance)
    columns = ["row_id", "features", "y", "category"]
    table = stage(pipeline.transform(seen).select("split", *columns), "refit-features")
    train = part(table, "train")
    if options.balance_classes:
        train = balance(train, config)
    return train, part(table, "val"), part(table, "test")


def run_offline(prepared: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """Prepared table to all result tables."""
    from tidegate.plans.train import train_all

    splits, _ = preprocess(prepared, config)
    splits = stage(splits, "splits")
    tables = evaluate(splits, train_all(splits, config), config)
    if config.loaco.enabled:
        results = stage(loaco(splits, config), "loaco-results")
        tables["loaco_results"] = results
        tables["loaco_summary"] = M.loaco_summary(results)
    return tables
