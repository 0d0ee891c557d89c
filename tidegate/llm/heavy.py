"""Joins to a table of distinct keys where one key may hold a large share of the other side's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: At most so many keys are broadcast; any other key holds at most one row in so many.
HEAVY_KEYS = 1000
#: Keys with fewer rows need no care.
HEAVY_ROWS = 200


def lookup(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, values: list[str], how: str = "inner") -> DataFrame:
    """`rows` with the `values` that `keyed` has for their `keys`; `how` says whether rows without a partner stay.

    `keyed` has each key once, and in `count` the number of rows that bear it. The HEAVY_KEYS keys with the most rows
    are broadcast, so their rows stay where they are; the others are shuffled. Both sides should be written tables.
    """
    most = keyed.filter(F.col(count) > HEAVY_ROWS).orderBy(F.desc(count), *keys).limit(HEAVY_KEYS)
    heavy = F.broadcast(most.select(*keys, *values, F.lit(True).alias("_heavy")))
    marked = rows.join(heavy, keys, "left")
    there = marked.filter("_heavy").drop("_heavy")
    rest = marked.filter(F.col("_heavy").isNull()).drop("_heavy", *values)
    return there.unionByName(rest.join(keyed.select(*keys, *values), keys, how).select(*there.columns))
