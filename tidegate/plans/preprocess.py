"""From the prepared table to train, validation and test features."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidegate.config import Config
from tidegate.models.features import FeaturePipeline, fit_feature_pipeline
from tidegate.operators import cleaning as C
from tidegate.operators.sampling import class_cap, stratified_split
from tidegate.operators.smote import smote
from tidegate.session import stage


def numbered(prepared: DataFrame) -> DataFrame:
    """The table with a row_id that is written once and therefore never changes."""
    if "row_id" in prepared.columns:
        return prepared
    return stage(prepared.withColumn("row_id", F.monotonically_increasing_id()), "numbered")


def split_table(prepared: DataFrame, config: Config = Config()) -> tuple[DataFrame, list[str]]:
    """Single-precision features, y, category and split of every row; and the feature names."""
    rows = numbered(prepared)
    names = [c for c in C.feature_names(rows) if c != "row_id"]
    labelled = C.sanitise_features(C.split_features_labels(rows), names)
    options = config.preprocess
    return stratified_split(
        labelled, options.test_size, options.validation_size, config.seed, key=["row_id"]), names


def balance(train: DataFrame, config: Config = Config()) -> DataFrame:
    """Training rows capped per category, then raised to equal sizes with synthetic rows."""
    options = config.preprocess
    capped = class_cap(train.select("row_id", "features", "category"), options.class_cap, config.seed, key=["row_id"])
    grown = smote(capped.withColumn("x", vector_to_array("features")), options.smote_neighbours, config.seed)
    return grown.select("row_id", array_to_vector("x").alias("features"), "y", "category")


def preprocess(prepared: DataFrame, config: Config = Config()) -> tuple[DataFrame, FeaturePipeline]:
    """The splits table (split, row_id, features, y, category) and the pipeline fitted on train."""
    split, names = split_table(prepared, config)
    split = stage(split, "split")
    options = config.preprocess
    pipeline = fit_feature_pipeline(split.filter("split = 'train'"), names, options.rfe_features, options.pca_variance)
    columns = ["row_id", "features", "y", "category"]
    table = pipeline.transform(split).select("split", *columns)
    if options.balance_classes:
        table = stage(table, "features")
        train = balance(table.filter("split = 'train'").select(columns), config)
        table = table.filter("split <> 'train'").unionByName(train.select(F.lit("train").alias("split"), *columns))
    return table, pipeline
