"""Jump consistent hashing: stable keys to shards without a table; further shards take rows only into themselves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidegate.llm.staging import Stage

#: Multiplier of the generator that decides the jumps (fixed value of the published method).
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: jumps ahead while they stay below the number of shards."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(moving):
            shard[moving] = ahead[moving]
            state[moving] = state[moving] * MULTIPLIER + np.uint64(1)
            scale = float(1 << 31) / ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            ahead[moving] = ((shard[moving] + 1) * scale).astype(np.int64)
            moving = moving[ahead[moving] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Column of shards from 0 for a column of 64-bit keys."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return shard(key)


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every document to a shard by its id.

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 8), text_crc32 (of the bytes; null: of none),
    law, shard, slot (place in the shard, gapless from 0 in ascending order of ids, equal ids in order of checksum)
    and grown_shard (with one more shard). Rows with equal ids share a shard. Rows without an id go where the
    checksum of their text leads, and come first. The rows of a shard are numbered by ranges of ids, so no task sees
    a whole shard.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    key = F.coalesce("doc_id", "text_crc32")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("row")]
    ranged = (
        rows.withColumn("shard", shard_of(key, shards)).withColumn("grown_shard", shard_of(key, shards + 1))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .withColumn("range", F.spark_partition_id())
    )
    staged = Stage(ranged, "shards").read()
    counts = staged.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    # a row per shard and range of ids
    before = F.sum("n").over(W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("shard", "range", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(W.partitionBy("shard", "range").orderBy(*order))
    return (
        staged.withColumn("number", number).join(offsets, ["shard", "range"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), "grown_shard")
    )
