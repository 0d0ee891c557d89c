"""From raw flow files to the prepared table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegate.config import Config
from tidegate.operators import cleaning as C
from tidegate.operators.sampling import stratified_sample
from tidegate.session import stage


def clean_flows(
    raw: DataFrame, fraction: float, seed: int, dedup: bool = True, min_samples: int = 0
) -> DataFrame:
    """Identifiers off, numbers repaired, incomplete and repeated rows out, labelled, sampled."""
    clean = raw.transform(C.drop_identifiers).transform(C.coerce_numeric).transform(C.drop_missing)
    if dedup:
        clean = clean.transform(C.drop_duplicates)
    labelled = clean.transform(C.normalise_labels)
    if min_samples > 0 or fraction < 1.0:
        # Counting and sampling read the cleaned rows several times.
        labelled = stage(labelled, "cleaned")
    return stratified_sample(C.drop_rare_categories(labelled, min_samples), fraction, seed)


def prepare(spark: SparkSession, raw_dir: str, config: Config = Config()) -> DataFrame:
    from tidegate.sources.flow_csv import load_raw

    data = config.data
    raw = load_raw(spark, raw_dir, data.file_glob)
    return clean_flows(raw, data.sample_fraction, config.seed, data.drop_duplicates, data.min_category_samples)
