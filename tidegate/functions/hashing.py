"""Seeded row hashes: the only source of randomness, so every recomputation agrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS


def row_hash(seed: int | str, columns: Sequence[str | Column]) -> Column:
    """64-bit hash of the given columns under a seed."""
    return F.xxhash64(F.lit(str(seed)), *columns)


def hash_bucket(hash_col: Column) -> Column:
    """The top bits of a hash as an order-preserving bucket number from 0."""
    return (F.shiftright(hash_col, 64 - BUCKET_BITS) + F.lit(BUCKETS // 2)).cast("int")


def unit_hash(hash_col: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(hash_col, 11).cast("double") * F.lit(2.0 ** -53)
