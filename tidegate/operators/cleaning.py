"""Cleaning of labelled flow tables: every step is a lazy frame-to-frame function."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegate.functions import labels as L
from tidegate.functions.numbers import finite_or_null, is_infinite, single_precision, to_number
from tidegate.schemas import BENIGN, CATEGORY, IDENTIFIER_COLUMNS, LABEL
from tidegate.session import small_table


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (LABEL, CATEGORY)]


def quoted(name: str):
    """Column reference for names with dots or slashes."""
    return F.col(f"`{name}`")


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def drop_identifiers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c in IDENTIFIER_COLUMNS])


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Feature columns to double; text that is not a number and infinities become null."""
    texts = {name for name, kind in df.dtypes if kind == "string"}
    out = []
    for name in df.columns:
        column = quoted(name)
        if name not in (LABEL, CATEGORY):
            number = to_number(column) if name in texts else column.cast("double")
            column = finite_or_null(number)
        out.append(column.alias(name))
    return df.select(out)


def count_infinite(df: DataFrame) -> DataFrame:
    """Number of infinite cells over all feature columns, text columns read as numbers."""
    per_column = [F.count_if(is_infinite(to_number(quoted(c)))) for c in feature_names(df)]
    total = per_column[0]
    for column in per_column[1:]:
        total = total + column
    return df.agg(total.alias("n_infinite"))


def inf_to_null(df: DataFrame) -> DataFrame:
    features = set(feature_names(df))
    numeric = {name for name, kind in df.dtypes if kind in ("double", "float")} & features
    return df.select([
        (finite_or_null(quoted(c)) if c in numeric else quoted(c)).alias(c) for c in df.columns
    ])


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows complete in every column, the label included."""
    present = [
        f"`{name}` IS NOT NULL" + (f" AND NOT isnan(`{name}`)" if kind in ("double", "float") else "")
        for name, kind in df.dtypes
    ]
    return df.filter(" AND ".join(present))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact copies collapse before the shuffle, so a large group of copies stays cheap."""
    return df.dropDuplicates()


def normalise_labels(df: DataFrame) -> DataFrame:
    if LABEL not in df.columns:
        raise KeyError(f"expected a {LABEL!r} column")
    return df.withColumn(CATEGORY, L.category(F.col(LABEL)))


def category_distribution(df: DataFrame, column: str = CATEGORY) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def drop_rare_categories(df: DataFrame, min_samples: int) -> DataFrame:
    """Without the attack categories of fewer than `min_samples` rows; 0 keeps all."""
    if min_samples <= 0:
        return df
    rare = df.groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("_n"))
    rare = rare.filter((F.col("_n") < min_samples) & (F.col(CATEGORY) != BENIGN)).select(CATEGORY)
    return df.join(small_table(rare), CATEGORY, "left_anti").select(df.columns)


def split_features_labels(df: DataFrame) -> DataFrame:
    """Features followed by y (1 for attack) and category."""
    features = [quoted(c).alias(c) for c in feature_names(df)]
    category = F.col(CATEGORY).cast("string")
    return df.select(*features, L.is_attack(category).alias("y"), category.alias("category"))


def sanitise_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Feature columns in single precision without missing or infinite values."""
    wanted = set(columns)
    return df.select([
        (single_precision(quoted(c)) if c in wanted else quoted(c)).alias(c) for c in df.columns
    ])


def normalise_label_types(df: DataFrame) -> DataFrame:
    return df.withColumns({"y": F.col("y").cast("int"), "category": F.col("category").cast("string")})


def mask_category(df: DataFrame, held_out: str, column: str = "category") -> DataFrame:
    """Everything but one category."""
    return df.filter(F.col(column) != held_out)
