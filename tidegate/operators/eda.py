"""Exploratory statistics over prepared flow tables: many columns per aggregate, one scan each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window, functions as F

from tidegate.functions.labels import is_attack
from tidegate.functions.numbers import ratio
from tidegate.operators.cleaning import category_distribution, feature_names, quoted
from tidegate.operators.quantiles import DIRECT_ROWS, attach, column_quantiles, plain_values, within
from tidegate.schemas import CATEGORY
from tidegate.session import small_table, stage

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def numeric_features(df: DataFrame) -> list[str]:
    kinds = dict(df.dtypes)
    return [c for c in feature_names(df) if kinds[c] in NUMERIC]


def per_column(df: DataFrame, columns: Sequence[str], measures: dict) -> DataFrame:
    """One aggregate over all columns, returned as one row per column (feature, measures...)."""
    cells = [
        F.struct(F.lit(c).alias("feature"), *[fn(quoted(c)).alias(name) for name, fn in measures.items()])
        for c in columns
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def class_distribution(df: DataFrame) -> DataFrame:
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())
    return category_distribution(df).withColumn("pct", share)


def missing_audit(df: DataFrame) -> DataFrame:
    """Missing and present values of every column, most missing first."""
    columns = feature_names(df)
    kinds = dict(df.dtypes)

    def gone(c):
        return quoted(c).isNull() | F.isnan(quoted(c)) if kinds[c] in ("double", "float") else quoted(c).isNull()

    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.count_if(gone(c)).alias("missing"))
             for i, c in enumerate(columns)]
    row = df.agg(F.array(*cells).alias("cells"), F.count(F.lit(1)).alias("rows"))
    table = row.select(F.inline("cells"), "rows")
    ordered = table.orderBy(F.desc("missing"), "position")
    return ordered.select("feature", "missing", (F.col("rows") - F.col("missing")).alias("present"))


def top_variance_features(df: DataFrame, k: int = 30) -> list[str]:
    """Names of the k numeric columns with the largest sample variance."""
    stats = per_column(df, numeric_features(df), {"variance": lambda c: F.var_samp(c.cast("double"))})
    return [r.feature for r in stats.orderBy(F.desc_nulls_last("variance"), "feature").limit(k).collect()]


def corr_matrix(df: DataFrame, max_features: int = 30) -> DataFrame:
    """Pearson matrix of the most variable columns as rows (a, b, r), rounded to 2 places.

    The result is max_features squared cells; constant columns give NaN.
    """
    names = top_variance_features(df, max_features)
    doubles = df.select([quoted(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)]).na.drop("any")
    assembler = VectorAssembler(inputCols=doubles.columns, outputCol="v")
    matrix = Correlation.corr(assembler.transform(doubles).select("v"), "v").first()[0].toArray()
    rows = [(a, b, float(matrix[i][j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    table = df.sparkSession.createDataFrame(rows, "a string, b string, r double")
    return table.withColumn("r", F.round("r", 2))


def label_correlation(df: DataFrame, top: int = 15) -> DataFrame:
    """Features with the strongest Pearson correlation with the attack flag, signed."""
    y = is_attack(F.col(CATEGORY)).cast("double")
    r = per_column(df, numeric_features(df), {"r": lambda c: F.try_divide(
        F.covar_pop(c.cast("double"), y), F.stddev_pop(c.cast("double")) * F.stddev_pop(F.when(c.isNotNull(), y)))})
    return r.filter("r is not null").orderBy(F.desc(F.abs("r")), "feature").limit(top)


def top_label_features(df: DataFrame, k: int) -> list[str]:
    return [row.feature for row in label_correlation(df, k).collect()]


def _by_feature(table: DataFrame, features: Sequence[str], ends: list) -> DataFrame:
    """(category, slot, ends) of a quantile table, for `attach`."""
    place = F.array_position(F.array(*[F.lit(c) for c in features]), F.col("feature")).cast("int") - 1
    return table.select(CATEGORY, place.alias("slot"), F.array(*ends).alias("ends"))


def boxplot_stats(
    df: DataFrame, features: Sequence[str], max_categories: int = 7, direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """Box and whisker numbers per feature and category, tails beyond .1 % and 99.9 % cut first."""
    features, width = list(features), len(features)
    top = small_table(category_distribution(df).limit(max_categories).select(CATEGORY))
    values = stage(plain_values(df.join(top, CATEGORY), features, CATEGORY), "boxes")
    names = [f"_{i}" for i in range(width)]
    tails = column_quantiles(values, names, [0.001, 0.999], CATEGORY, direct_rows)
    q = F.col("q")
    cut = attach(values, _by_feature(tails, names, [q[0], q[1]]), width, CATEGORY)
    trimmed = cut.select(CATEGORY, *[
        F.when(within(F.col(c), F.col("_b")[i]), F.col(c)).alias(c) for i, c in enumerate(names)])
    boxes = small_table(column_quantiles(trimmed, names, [0.25, 0.5, 0.75], CATEGORY, direct_rows))
    reach = 1.5 * (q[2] - q[0])
    fenced = attach(trimmed, _by_feature(boxes, names, [q[0] - reach, q[2] + reach]), width, CATEGORY)
    cells = []
    for i, c in enumerate(names):
        v, ends = F.col(c), F.col("_b")[i]
        cells.append(F.struct(
            F.lit(c).alias("feature"), F.lit(features[i]).alias("name"),
            F.min(F.when(v >= ends[0], v)).alias("whisker_low"), F.max(F.when(v <= ends[1], v)).alias("whisker_high")))
    whiskers = fenced.groupBy(CATEGORY).agg(F.array(*cells).alias("c")).select(CATEGORY, F.inline("c"))
    return boxes.join(whiskers, ["feature", CATEGORY]).select(
        F.col("name").alias("feature"), CATEGORY, "n", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"),
        "whisker_low", "whisker_high")


def outlier_summary(df: DataFrame, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Count and share of values outside 1.5 interquartile ranges, per feature."""
    features = numeric_features(df)
    values = stage(plain_values(df, features, None), "outliers")
    names = [f"_{i}" for i in range(len(features))]
    boxes = column_quantiles(values, names, [0.25, 0.75], direct_rows=direct_rows)
    fences = {r.feature: (r.q[0] - 1.5 * (r.q[1] - r.q[0]), r.q[1] + 1.5 * (r.q[1] - r.q[0])) for r in boxes.collect()}
    cells = []
    for c, name in zip(features, names):
        low, high = fences.get(name, (float("-inf"), float("inf")))
        outside = (F.col(name) < F.lit(low)) | (F.col(name) > F.lit(high))
        cells.append(F.struct(F.lit(c).alias("feature"), F.count_if(outside).alias("outlier_count")))
    row = values.agg(F.array(*cells).alias("cells"), F.count(F.lit(1)).alias("rows"))
    flat = row.select(F.inline("cells"), "rows")
    pct = F.round(100 * ratio(F.col("outlier_count"), F.col("rows")), 2)
    return flat.select("feature", "outlier_count", pct.alias("outlier_pct")).orderBy(F.desc("outlier_pct"), "feature")


def per_class_stats(df: DataFrame, features: Sequence[str], direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """n, mean, median and sample deviation per feature and category."""
    values = stage(plain_values(df, features, CATEGORY), "classes")
    names = [f"_{i}" for i in range(len(features))]
    cells = [
        F.struct(F.lit(c).alias("feature"), F.lit(features[i]).alias("name"), F.avg(c).alias("mean"),
                 F.stddev_samp(c).alias("std"))
        for i, c in enumerate(names)
    ]
    moments = values.groupBy(CATEGORY).agg(F.array(*cells).alias("c")).select(CATEGORY, F.inline("c"))
    medians = column_quantiles(values, names, [0.5], CATEGORY, direct_rows)
    return medians.join(small_table(moments), ["feature", CATEGORY]).select(
        F.col("name").alias("feature"), F.col(CATEGORY).alias("category"), "n", "mean", F.col("q")[0].alias("median"), "std")


def summary(df: DataFrame) -> DataFrame:
    """Row count, column count and share of attack rows."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
        F.avg(is_attack(F.col(CATEGORY)).cast("double")).alias("attack_ratio"),
    )


def profile(df: DataFrame, direct_rows: int = DIRECT_ROWS) -> dict[str, DataFrame]:
    """All exploratory tables of a prepared flow table."""
    leading = top_label_features(df, 15)
    return {
        "class_distribution": class_distribution(df),
        "missing_audit": missing_audit(df),
        "corr_matrix": corr_matrix(df),
        "label_correlation": label_correlation(df),
        "boxplot_stats": boxplot_stats(df, leading[:6], direct_rows=direct_rows),
        "outlier_summary": outlier_summary(df, direct_rows=direct_rows),
        "per_class_stats": per_class_stats(df, leading[:10], direct_rows=direct_rows),
        "summary": summary(df),
    }
