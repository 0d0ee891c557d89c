"""Stored tables: prepared flows, decisions, ground truth, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegate.schemas import DECISION_BATCH, GROUND_TRUTH


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_decisions_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DECISION_BATCH).option("header", True).option("emptyValue", "").csv(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GROUND_TRUTH).option("header", True).csv(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; the partition filter prunes the files of the others."""
    return spark.read.parquet(path).filter(f"split = '{split}'").drop("split")
