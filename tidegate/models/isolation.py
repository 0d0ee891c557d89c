"""Isolation forest: trees grown on small per-tree samples, scored with the node table."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegate.functions.hashing import row_hash, unit_hash
from tidegate.operators.sampling import subsample_rows
from tidegate.session import fit_input

NODE_SCHEMA = "tree int, node int, feature int, threshold double, path double"
EULER = 0.5772156649015329


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def grow_tree(points: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple[int, int, float, float]]:
    """Nodes (heap position, feature or -1, threshold, path length at a leaf) of one random tree."""
    nodes, todo = [], [(0, 0, np.arange(len(points)))]
    while todo:
        position, depth, members = todo.pop()
        block = points[members]
        low, high = block.min(axis=0), block.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= max_depth or len(members) <= 1 or usable.size == 0:
            nodes.append((position, -1, 0.0, depth + average_path(len(members))))
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        left = block[:, feature] <= threshold
        nodes.append((position, feature, threshold, 0.0))
        todo.append((2 * position + 1, depth + 1, members[left]))
        todo.append((2 * position + 2, depth + 1, members[~left]))
    return nodes


@dataclass(frozen=True)
class IsolationForest:
    """Node arrays of shape (trees, 2^(depth+1) - 1); their size depends on the settings only."""

    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    sample_size: int

    def raw_scores(self, matrix: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for rows that are isolated early."""
        rows = np.arange(len(matrix))
        total = np.zeros(len(matrix))
        depth = int(math.log2(self.feature.shape[1] + 1)) - 1
        for feature, threshold, path in zip(self.feature, self.threshold, self.path, strict=True):
            at = np.zeros(len(matrix), dtype=np.int64)
            for _ in range(depth):
                split = feature[at]
                inner = split >= 0
                right = matrix[rows, np.maximum(split, 0)] > threshold[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += path[at]
        return np.exp2(-total / len(self.feature) / average_path(self.sample_size))

    def score(self, spark, vector: str = "features") -> Column:
        """The raw score as a vectorised expression over a broadcast forest."""
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def isolation(values: pd.Series) -> pd.Series:
            return pd.Series(shared.value.raw_scores(np.stack(values.to_numpy())))

        return isolation(vector_to_array(F.col(vector)))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `raw` and `yhat` (1 when the score exceeds .5)."""
        scored = df.withColumn("raw", self.score(df.sparkSession))
        return scored.withColumn("yhat", (F.col("raw") > 0.5).cast("int"))


def scale_scores(scored: DataFrame, raw: str = "raw", output: str = "p") -> DataFrame:
    """Min-max over the scored rows; all 0 when they hardly differ."""
    limits = scored.agg(F.struct(F.min(raw).alias("low"), F.max(raw).alias("high")).alias("limits"))
    span = limits.scalar()
    width = span["high"] - span["low"]
    value = F.when(width < 1e-9, F.lit(0.0)).otherwise((F.col(raw) - span["low"]) / F.greatest(width, F.lit(1e-9)))
    return scored.withColumn(output, value)


def fit_isolation_forest(
    benign: DataFrame, trees: int = 200, sample_size: int = 256, max_rows: int | None = None, seed: int = 42
) -> IsolationForest:
    """Expects row_id and features; trees draw from all rows unless `max_rows` is given. A task never holds more than a few samples of `sample_size` rows."""
    base = subsample_rows(benign.select("row_id", "features"), max_rows, seed, key=["row_id"])
    with fit_input(base.select("row_id", vector_to_array("features").alias("x"))) as base:
        rows = base.count()
        size = min(sample_size, rows)
        # A row joins a tree's candidates with a probability that leaves more than enough of them.
        chance = min(1.0, (size + 10.0 * math.sqrt(size) + 50.0) / max(rows, 1))
        tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
        candidates = base.select("row_id", "x", tree.alias("tree")).withColumn("_h", row_hash(seed, ["tree", "row_id"]))
        candidates = candidates.filter(unit_hash(F.col("_h")) < chance)
        place = F.row_number().over(Window.partitionBy("tree").orderBy("_h", "row_id"))
        sample = candidates.withColumn("_place", place).filter(F.col("_place") <= size).select("tree", "row_id", "x")
        depth = max(1, math.ceil(math.log2(max(size, 2))))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            ordered = pdf.sort_values("row_id")
            number = int(ordered["tree"].iloc[0])
            nodes = grow_tree(np.stack(ordered["x"].to_numpy()), np.random.default_rng([seed, number]), depth)
            return pd.DataFrame([(number, *node) for node in nodes], columns=["tree", "node", "feature", "threshold", "path"])

        table = sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    return _from_nodes(table, trees, depth, size)


def _from_nodes(table: pd.DataFrame, trees: int, depth: int, size: int) -> IsolationForest:
    width = 2 ** (depth + 1) - 1
    feature = np.full((trees, width), -1, dtype=np.int32)
    threshold, path = np.zeros((trees, width)), np.zeros((trees, width))
    at = (table["tree"].to_numpy(), table["node"].to_numpy())
    feature[at], threshold[at], path[at] = table["feature"], table["threshold"], table["path"]
    return IsolationForest(feature, threshold, path, size)


def save_forest(forest: IsolationForest, spark, path: str) -> None:
    trees, width = forest.feature.shape
    tree, node = np.divmod(np.arange(trees * width), width)
    table = pd.DataFrame({
        "tree": tree, "node": node, "feature": forest.feature.ravel(), "threshold": forest.threshold.ravel(),
        "path": forest.path.ravel(), "sample_size": forest.sample_size,
    })
    spark.createDataFrame(table).write.mode("overwrite").parquet(path)


def load_forest(spark, path: str) -> IsolationForest:
    table = spark.read.parquet(path).toPandas()
    trees, width = table["tree"].max() + 1, table["node"].max() + 1
    return _from_nodes(table, int(trees), int(math.log2(width + 1)) - 1, int(table["sample_size"].iloc[0]))
