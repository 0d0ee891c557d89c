"""Result tables of the offline jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidegate.operators.cleaning import category_distribution


def write_prepared(prepared: DataFrame, path: str) -> DataFrame:
    """Writes the prepared table and returns its category counts."""
    prepared.write.mode("overwrite").parquet(path)
    return category_distribution(prepared.sparkSession.read.parquet(path))


def write_splits(splits: DataFrame, path: str) -> None:
    splits.write.mode("overwrite").partitionBy("split").parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One folder per result table; `fmt` is parquet or csv."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{folder}/{name}")
