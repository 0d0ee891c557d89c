"""Feature pipeline: standard scaling, recursive elimination, principal components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.functions.numbers import single_precision
from tidegate.operators.cleaning import quoted
from tidegate.session import fit_input

ELIMINATION_STEP = 0.1


@dataclass(frozen=True)
class FeaturePipeline:
    """Fitted stages and what they kept; `transform` works on batches and streams."""

    stages: PipelineModel
    input_names: list[str]
    selected: list[str]
    n_components: int
    explained_variance: float

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `features`; inputs the frame lacks count as 0, as do missing and infinite values."""
        missing = [c for c in self.selected if c not in df.columns]
        filled = df.withColumns({c: F.lit(0.0) for c in missing}) if missing else df
        out = self.stages.transform(filled)
        return out.select(*[quoted(c) for c in df.columns], "features")

    def diagnostics(self, spark) -> DataFrame:
        row = (len(self.input_names), len(self.selected), self.n_components, self.explained_variance, self.selected)
        return spark.createDataFrame(
            [row], "input_features int, kept int, components int, explained_variance double, selected array<string>")


def column_moments(df: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations of all columns from one aggregate; deviation 0 becomes 1."""
    row = df.agg(F.array(*[F.avg(quoted(c)) for c in names]).alias("m"),
                 F.array(*[F.stddev_pop(quoted(c)) for c in names]).alias("s")).first()
    mean = np.array([0.0 if v is None else v for v in row.m])
    scale = np.array([1.0 if not v else v for v in row.s])
    return mean, scale


def standard_scale(df: DataFrame, names: list[str]) -> DataFrame:
    """z-scores with the population deviation; constant columns become 0."""
    mean, scale = column_moments(df, names)
    position = {c: i for i, c in enumerate(names)}
    return df.select([
        ((quoted(c) - F.lit(float(mean[position[c]]))) / F.lit(float(scale[position[c]]))).alias(c)
        if c in position else quoted(c)
        for c in df.columns
    ])


def _scaling_stage(names: list[str], mean: np.ndarray, scale: np.ndarray) -> SQLTransformer:
    cells = []
    for i, (name, m, s) in enumerate(zip(names, mean, scale, strict=True)):
        x = f"CAST(`{name}` AS DOUBLE)"
        finite = f"CASE WHEN abs({x}) = double('Infinity') OR isnan({x}) OR {x} IS NULL THEN 0D ELSE {x} END"
        cells.append(f"(CAST(CAST({finite} AS FLOAT) AS DOUBLE) - {float(m)!r}D) / {float(s)!r}D AS _z{i}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__")


def eliminate(vectors: DataFrame, n_features: int, keep: int, rows: int, c: float = 1.0) -> list[int]:
    """Positions that survive when the weakest coefficients of a ridge logistic fit are dropped in turn."""
    alive = list(range(n_features))
    step = max(1, int(ELIMINATION_STEP * n_features))
    while len(alive) > keep:
        sliced = VectorSlicer(inputCol="scaled", outputCol="features", indices=alive).transform(vectors)
        fit = LogisticRegression(
            featuresCol="features", labelCol="y", regParam=1.0 / (c * rows), elasticNetParam=0.0,
            standardization=False, maxIter=50, tol=1e-5,
        ).fit(sliced.select("features", "y"))
        weakest = np.argsort(np.square(fit.coefficients.toArray()), kind="stable")
        dropped = set(weakest[: min(step, len(alive) - keep)].tolist())
        alive = [name for i, name in enumerate(alive) if i not in dropped]
    return alive


def components_for(variance: np.ndarray, wanted: float) -> int:
    """Smallest number of components whose explained share exceeds `wanted`."""
    return min(int(np.searchsorted(np.cumsum(variance), wanted, side="right")) + 1, len(variance))


def fit_feature_pipeline(
    train: DataFrame, names: list[str], n_features: int = 30, pca_variance: float = 0.95
) -> FeaturePipeline:
    """Fits all stages on training rows with column y."""
    keep = min(int(n_features), len(names))
    if keep < 1:
        raise ValueError("at least one feature must be kept")
    clean = train.select(*[single_precision(quoted(c)).cast("double").alias(c) for c in names],
                         F.col("y").cast("double").alias("y"))
    mean, scale = column_moments(clean, names)
    scaling = _scaling_stage(names, mean, scale)
    assembled = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(names))], outputCol="scaled")
    vectors = assembled.transform(scaling.transform(clean)).select("scaled", "y")
    with fit_input(vectors, "scaled") as vectors:
        alive = eliminate(vectors, len(names), keep, vectors.count())
        sliced = VectorSlicer(inputCol="scaled", outputCol="kept", indices=alive).transform(vectors)
        pca = PCA(k=len(alive), inputCol="kept", outputCol="_pc").fit(sliced)
    variance = pca.explainedVariance.toArray()
    k = components_for(variance, pca_variance)
    selected = [names[i] for i in alive]
    stages = PipelineModel(stages=[
        _scaling_stage(selected, mean[alive], scale[alive]),
        VectorAssembler(inputCols=[f"_z{i}" for i in range(len(alive))], outputCol="kept"),
        pca,
        VectorSlicer(inputCol="_pc", outputCol="features", indices=list(range(k))),
    ])
    return FeaturePipeline(stages, list(names), selected, k, float(variance[:k].sum()))


def save_pipeline(pipeline: FeaturePipeline, path: str) -> None:
    pipeline.stages.write().overwrite().save(f"{path}/stages")
    SparkSession.active().createDataFrame(
        [(pipeline.input_names, pipeline.selected, pipeline.n_components, pipeline.explained_variance)],
        "input_names array<string>, selected array<string>, n_components int, explained_variance double",
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/info")


def load_pipeline(spark, path: str) -> FeaturePipeline:
    info = spark.read.parquet(f"{path}/info").first()
    return FeaturePipeline(PipelineModel.load(f"{path}/stages"), list(info.input_names), list(info.selected),
                           info.n_components, info.explained_variance)
