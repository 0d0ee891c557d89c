"""A training corpus in five stages: toxic documents go, one document of each group of near copies stays, repeated
paragraphs are cut, contaminated documents go, and what is left is packed into token sequences.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; run() writes each result
as Parquet below the shared checkpoint folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.llm import decontaminate, jaccard_join, packing, paragraph_dedup, toxicity
from tidegate.llm.staging import Stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    model = toxicity.fit_documents(docs, _table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of documents linked by similar shingle sets."""
    return jaccard_join.one_of_each(docs, jaccard_join.jaccard_components(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs that an earlier one has; those of which nothing is left go."""
    cut = paragraph_dedup.remove_paragraphs(docs)
    changed = F.col("n_removed") > 0
    return cut.filter(~changed | F.col("kept").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")).withColumns({
        "text": F.when(changed, F.col("kept")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")),
    }).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than the allowed share stands in windows of benchmark items."""
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return decontaminate.remove_documents(docs, found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in packed sequences."""
    return packing.pack_documents(docs).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The first and the last stage have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of a folder."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        after = Stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            before.drop()
        docs, before = after.read(), after
    return docs
