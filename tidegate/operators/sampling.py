"""Exact-size seeded sampling and splitting without ranking whole strata.

Rows are ordered by a seeded hash. A first pass counts rows per stratum and hash bucket; the
cut points of a stratum then fall into a few buckets, and only the rows of those buckets are
ranked. All other rows are assigned by comparing their bucket number with the cuts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidegate.functions.hashing import BUCKETS, hash_bucket, row_hash
from tidegate.operators.cleaning import quoted
from tidegate.session import small_table

COPY_CHUNK = 100_000


def assign_parts(
    df: DataFrame,
    by: Sequence[str],
    seed: int,
    limits: Callable[[DataFrame], DataFrame],
    parts: int,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Adds `_part`: 0 for the first rows of a stratum in hash order, up to `parts` - 1.

    `limits` receives one row per stratum (`by` columns and `n`) and adds the cumulative sizes
    `_k1` .. `_k{parts-1}` of the first parts. `key` names columns that identify a row; without
    one, equal rows are interchangeable and are collapsed before they are ranked.
    """
    cols = df.columns
    stratum = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    identity = [quoted(c) for c in (key or cols)]
    hashed = base.withColumn("_h", row_hash(seed, identity)).withColumn("_b", hash_bucket(F.col("_h")))
    cuts = small_table(_cut_table(hashed, stratum, limits, parts))
    placed = _join_strata(hashed, cuts, stratum)

    names = [f"_cut{j}" for j in range(1, parts)]
    in_cut = F.lit(False)
    before_bucket = F.lit(0)
    part_of_bucket = F.lit(0)
    for name in names:
        in_cut = in_cut | (F.col("_b") == F.col(f"{name}.bucket"))
        before_bucket = F.when(F.col("_b") == F.col(f"{name}.bucket"), F.col(f"{name}.before")).otherwise(before_bucket)
        part_of_bucket = part_of_bucket + (F.col("_b") > F.col(f"{name}.bucket")).cast("int")
    sure = placed.filter(~in_cut).withColumn("_part", part_of_bucket)
    unsure = placed.filter(in_cut).withColumn("_before", before_bucket)
    limit_cols = [F.col(f"_k{j}") for j in range(1, parts)]
    if key:
        rank = F.row_number().over(Window.partitionBy(*stratum, "_b").orderBy("_h", *identity)) + F.col("_before")
        ranked = unsure.withColumn("_rank", rank)
        part = sum(((F.col("_rank") > k).cast("int") for k in limit_cols), F.lit(0))
        cut_rows = ranked.withColumn("_part", part)
    else:
        cut_rows = _rank_copies(unsure, cols, stratum, limit_cols)
    output = [quoted(c) for c in cols] + [F.col("_part")]
    return sure.select(output).unionByName(cut_rows.select(output))


def _join_strata(left: DataFrame, right: DataFrame, stratum: list[str]) -> DataFrame:
    """Inner join on the strata, where rows without a value are a stratum of their own."""
    renamed = right.withColumnsRenamed({c: f"_of_{c}" for c in stratum})
    same = F.lit(True)
    for c in stratum:
        same &= left[quoted_name(c)].eqNullSafe(renamed[quoted_name(f"_of_{c}")])
    return left.join(renamed, same).drop(*[f"_of_{c}" for c in stratum])


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _cut_table(hashed: DataFrame, stratum: list[str], limits, parts: int) -> DataFrame:
    counts = hashed.groupBy(*stratum, "_b").agg(F.count(F.lit(1)).alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(*stratum).orderBy("_b"))
    buckets = counts.withColumn("_cum", running)
    totals = limits(counts.groupBy(*stratum).agg(F.sum("_n").alias("n"))).drop("n")
    joined = _join_strata(buckets, totals, stratum)
    cuts = []
    for j in range(1, parts):
        first = F.min(F.when(F.col("_cum") >= F.col(f"_k{j}"),
                             F.struct(F.col("_b").alias("bucket"), (F.col("_cum") - F.col("_n")).alias("before"))))
        nowhere = F.struct(F.lit(BUCKETS).alias("bucket"), F.lit(0).cast("long").alias("before"))
        none = F.struct(F.lit(-1).alias("bucket"), F.lit(0).cast("long").alias("before"))
        cuts.append(F.when(F.max(f"_k{j}") <= 0, none).otherwise(F.coalesce(first, nowhere)).alias(f"_cut{j}"))
    sizes = [F.max(f"_k{j}").cast("long").alias(f"_k{j}") for j in range(1, parts)]
    return joined.groupBy(*stratum).agg(*sizes, *cuts)


def _rank_copies(unsure: DataFrame, cols: list[str], stratum: list[str], limit_cols: list) -> DataFrame:
    """Ranks rows that have no key: equal rows are counted once, shared out, and expanded again."""
    extra = [c for c in ["_b", "_h", "_before", *stratum] if c not in cols]
    ks = [f"_k{j}" for j in range(1, len(limit_cols) + 1)]
    grouped = unsure.groupBy(*[quoted(c) for c in cols + extra + ks]).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*stratum, "_b").orderBy("_h", *[quoted(c) for c in cols])
    end = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")
    ranked = grouped.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_c"))
    shares, low = [], F.lit(0).cast("long")
    for j, high in enumerate([*limit_cols, F.col("_end")]):
        count = F.least(F.col("_end"), high) - F.greatest(F.col("_start"), low)
        shares.append(F.struct(F.lit(j).alias("_part"), count.alias("_m")))
        low = high
    shared = ranked.select("*", F.inline(F.array(*shares))).filter("_m > 0")
    chunks = F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / COPY_CHUNK).cast("int"))
    chunked = shared.withColumn("_chunk", F.explode(chunks)).repartition(F.col("_h"), F.col("_chunk"))
    rows = F.least(F.lit(COPY_CHUNK), F.col("_m") - F.col("_chunk") * COPY_CHUNK).cast("int")
    return chunked.withColumn("_copy", F.explode(F.sequence(F.lit(1), rows)))


def stratified_sample(
    df: DataFrame, fraction: float, seed: int, by: str = "Category", key: Sequence[str] | None = None
) -> DataFrame:
    """Exactly round-half-even(fraction * n) rows of every category."""
    if fraction >= 1.0:
        return df
    if by not in df.columns:
        raise KeyError(f"column {by!r} is needed for stratified sampling")

    def limits(totals):
        return totals.withColumn("_k1", F.bround(F.col("n") * F.lit(float(fraction)), 0).cast("long"))

    return assign_parts(df, [by], seed, limits, 2, key).filter("_part = 0").drop("_part")


def class_cap(df: DataFrame, cap: int, seed: int, by: str = "category", key: Sequence[str] | None = None) -> DataFrame:
    """At most `cap` rows of every category."""
    def limits(totals):
        return totals.withColumn("_k1", F.least(F.col("n"), F.lit(cap).cast("long")))

    return assign_parts(df, [by], seed, limits, 2, key).filter("_part = 0").drop("_part")


def subsample_rows(df: DataFrame, rows: int | None, seed: int, key: Sequence[str] | None = None) -> DataFrame:
    """Exactly min(rows, n) rows; None keeps all."""
    if rows is None:
        return df

    def limits(totals):
        return totals.withColumn("_k1", F.least(F.col("n"), F.lit(rows).cast("long")))

    return assign_parts(df, [], seed, limits, 2, key).filter("_part = 0").drop("_part")


def _largest_remainder(strata: DataFrame, count_col: str, by: str, total, out: str) -> DataFrame:
    """Integer shares of `total` proportional to a count column; one row per category comes in."""
    everything = Window.partitionBy()
    exact = total * F.col(count_col) / F.sum(count_col).over(everything)
    staged = strata.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.col("_floor"))
    missing = total - F.sum("_floor").over(everything)
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), by))
    shared = staged.withColumn("_extra", (place <= missing).cast("long"))
    return shared.withColumn(out, F.col("_floor") + F.col("_extra")).drop("_floor", "_rest", "_extra")


def split_sizes(totals: DataFrame, by: str, test_size: float, val_size: float) -> DataFrame:
    """Rows of test and validation per category: both totals are rounded up, shares kept."""
    everything = Window.partitionBy()
    n_all = F.sum("n").over(everything)
    keep = n_all - F.ceil(n_all * F.lit(test_size))
    first = _largest_remainder(totals.withColumn("_keep", keep), "n", by, F.col("_keep"), "_rest_n")
    relative = val_size / (1.0 - test_size)
    train = F.col("_keep") - F.ceil(F.col("_keep") * F.lit(relative))
    second = _largest_remainder(first.withColumn("_train", train), "_rest_n", by, F.col("_train"), "n_train")
    return second.select(
        by, "n", (F.col("n") - F.col("_rest_n")).cast("long").alias("n_test"),
        (F.col("_rest_n") - F.col("n_train")).cast("long").alias("n_val"), F.col("n_train").cast("long"),
    )


def stratified_split(
    df: DataFrame, test_size: float, val_size: float, seed: int, by: str = "category",
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Adds `split` (train, val or test) with the category shares kept in each."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be between 0 and 1")
    if not 0.0 < val_size < 1.0:
        raise ValueError("val_size must be between 0 and 1")
    if test_size + val_size >= 1.0:
        raise ValueError("test_size + val_size must be less than 1")

    def limits(totals):
        sizes = split_sizes(totals, by, test_size, val_size)
        return sizes.select(by, "n", F.col("n_test").alias("_k1"), (F.col("n_test") + F.col("n_val")).alias("_k2"))

    parts = assign_parts(df, [by], seed, limits, 3, key)
    name = F.when(F.col("_part") == 0, "test").when(F.col("_part") == 1, "val").otherwise("train")
    return parts.withColumn("split", name).drop("_part")


def stratified_folds(
    df: DataFrame, folds: int, seed: int, by: str | Sequence[str] = "y", key: Sequence[str] | None = None
) -> DataFrame:
    """Adds `fold` in 0..folds-1 with sizes per class (or combination of `by`) that differ by at most one."""
    def limits(totals):
        for j in range(1, folds):
            totals = totals.withColumn(f"_k{j}", F.floor(F.col("n") * j / folds).cast("long"))
        return totals

    strata = [by] if isinstance(by, str) else by
    return assign_parts(df, strata, seed, limits, folds, key).withColumnRenamed("_part", "fold")
