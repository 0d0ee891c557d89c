"""Exact linearly interpolated quantiles of many columns at once, without a row per value.

One aggregate sketches every column and gives brackets around the wanted ranks, a second counts the
values below and inside each bracket. Only the values inside become rows, are counted by value and
ranked. The counts decide whether a bracket is used, so the sketch cannot change the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegate.operators.cleaning import quoted
from tidegate.session import small_table

DIRECT_ROWS = 1_000_000
ACCURACY = 10_000
MARGIN = 3.0 / ACCURACY
GRID = 1000
MAX_ROUNDS = 6


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: str | None = None,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Rows (by, feature, n, q): q lists the quantiles in the order of `probs`.

    Nulls and NaNs are ignored, and so are rows without a group; a column without values has no row.
    Brackets are narrowed while one holds more than `direct_rows` values. Groups are meant to be few.
    """
    keys, width = [by] if by else [], len(probs)
    values = plain_values(df, columns, by)
    state = small_table(_first_brackets(values, len(columns), probs, keys))
    largest = None
    for _ in range(MAX_ROUNDS):
        state = small_table(_adopt(state, _counts(values, state, len(columns), width, by), keys))
        inside = state.agg(F.max("inside")).first()[0] or 0
        if inside <= direct_rows or (largest is not None and inside >= largest):
            break
        largest = inside
        state = small_table(_narrowed(values, state, len(columns), width, by))
    ranked = _ranked(values, state, len(columns), width, by)
    names = F.array(*[F.lit(c) for c in columns])
    cell = F.floor(F.col("slot") / width).cast("int")
    listed = [F.max(F.when(F.col("slot") % width == j, F.col("quantile"))) for j in range(width)]
    return ranked.groupBy(*keys, F.get(names, cell).alias("feature"), "n").agg(F.array(*listed).alias("q"))


def plain_values(df: DataFrame, columns: Sequence[str], by: str | None) -> DataFrame:
    """The group and the columns as doubles _0, _1, ...; NaN becomes null."""
    cells = []
    for i, c in enumerate(columns):
        v = quoted(c).cast("double")
        cells.append(F.when(~F.isnan(v), v).alias(f"_{i}"))
    return df.filter(quoted(by).isNotNull()).select(quoted(by), *cells) if by else df.select(*cells)


def attach(values: DataFrame, table: DataFrame, slots: int, by: str | None, name: str = "_b") -> DataFrame:
    """Adds the lists `ends` of a small table (by, slot, ends) as one list by slot; null where it has none."""
    keys = [by] if by else []
    packed = table.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("slot", "ends"))).alias("m"))
    placed = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: F.try_element_at("m", s))
    listed = small_table(packed.select(*keys, placed.alias(name)))
    if by:
        return values.join(listed, by)
    ends = listed.first()
    if ends is None:
        return values.withColumn(name, F.lit(None).cast("array<array<double>>"))
    lists = [F.lit(None).cast("array<double>") if e is None else F.array(*[F.lit(x) for x in e]) for e in ends[0]]
    return values.withColumn(name, F.array(*lists))


def within(value: Column, ends: Column) -> Column:
    return (value >= ends[0]) & (value <= ends[1])


def _ends(low: str, high: str) -> Column:
    return F.array(low, high).alias("ends")


def _first_brackets(values: DataFrame, cells: int, probs: Sequence[float], keys: list[str]) -> DataFrame:
    """One row per group, column and probability; new_lo and new_hi come from a sketch of the column."""
    marks = [min(max(p + side * MARGIN, 0.0), 1.0) for p in probs for side in (-1, 1)]
    sketches = [
        F.struct(F.lit(i).alias("cell"), F.count(f"_{i}").alias("n"),
                 F.percentile_approx(f"_{i}", marks, ACCURACY).alias("marks"))
        for i in range(cells)
    ]
    rows = values.groupBy(*keys).agg(F.array(*sketches).alias("c")).select(*keys, F.inline("c")).filter("n > 0")
    places = F.array(*[F.struct(F.lit(j).alias("place"), F.lit(float(p)).alias("prob")) for j, p in enumerate(probs)])
    position = F.col("prob") * (F.col("n") - 1)
    return rows.select(*keys, "cell", "n", "marks", F.inline(places)).select(
        *keys, (F.col("cell") * len(probs) + F.col("place")).alias("slot"), "n",
        F.floor(position).alias("k"), (position - F.floor(position)).alias("f"),
        F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"),
        F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"),
        F.get("marks", 2 * F.col("place")).alias("new_lo"), F.get("marks", 2 * F.col("place") + 1).alias("new_hi"),
    )


def _counts(values: DataFrame, state: DataFrame, cells: int, width: int, by: str | None) -> DataFrame:
    keys = [by] if by else []
    joined = attach(values, state.select(*keys, "slot", _ends("new_lo", "new_hi")), cells * width, by)
    counters = []
    for s in range(cells * width):
        v, ends = F.col(f"_{s // width}"), F.col("_b")[s]
        counters.append(F.struct(
            F.lit(s).alias("slot"), F.count_if(v < ends[0]).alias("new_below"),
            F.count_if(within(v, ends)).alias("new_inside")))
    return joined.groupBy(*keys).agg(F.array(*counters).alias("c")).select(*keys, F.inline("c"))


def _adopt(state: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """A new bracket replaces the old one if both ranks around the quantile lie in it."""
    joined = state.join(counted, [*keys, "slot"])
    last = F.least(F.col("k") + 2, F.col("n"))
    good = (F.col("new_below") <= F.col("k")) & (F.col("new_below") + F.col("new_inside") >= last)
    picked = [F.when(good, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("lo", "hi", "below", "inside")]
    return joined.select(*keys, "slot", "n", "k", "f", *picked)


def _narrowed(values: DataFrame, state: DataFrame, cells: int, width: int, by: str | None) -> DataFrame:
    """New brackets a few steps of a grid wide, from a sketch of the values in the present ones."""
    keys, grid = [by] if by else [], [i / GRID for i in range(GRID + 1)]
    joined = attach(values, state.select(*keys, "slot", _ends("lo", "hi")), cells * width, by)
    sketches = []
    for s in range(cells * width):
        v = F.col(f"_{s // width}")
        inner = F.when(within(v, F.col("_b")[s]), v)
        sketches.append(F.struct(F.lit(s).alias("slot"), F.percentile_approx(inner, grid, ACCURACY).alias("grid")))
    points = joined.groupBy(*keys).agg(F.array(*sketches).alias("c")).select(*keys, F.inline("c"))
    step = F.floor((F.col("k") + 1 - F.col("below")) * GRID / F.col("inside")).cast("int")
    return state.join(points, [*keys, "slot"]).withColumns({
        "new_lo": F.get("grid", F.greatest(step - 1, F.lit(0))),
        "new_hi": F.get("grid", F.least(step + 3, F.lit(GRID))),
    }).drop("grid")


def _ranked(values: DataFrame, state: DataFrame, cells: int, width: int, by: str | None) -> DataFrame:
    """Counts by value inside the brackets, then the two values around each rank.

    A bracket of one value needs no count. Rows outside the others are filtered before any row is made.
    """
    keys = [by] if by else []
    single = F.col("lo") == F.col("hi")
    solved = state.filter(single).select(*keys, "slot", "n", F.col("lo").alias("quantile"))
    unsolved = state.filter(~single)
    wanted = sorted(r.slot for r in unsolved.select("slot").distinct().collect())
    if not wanted:
        return solved
    joined = attach(values, unsolved.select(*keys, "slot", _ends("lo", "hi")), cells * width, by)
    inside = {s: within(F.col(f"_{s // width}"), F.col("_b")[s]) for s in wanted}
    points = [F.when(test, F.struct(F.lit(s).alias("slot"), F.col(f"_{s // width}").alias("v"))) for s, test in inside.items()]
    near = joined.filter(reduce(or_, [F.coalesce(test, F.lit(False)) for test in inside.values()]))
    rows = near.select(*keys, F.inline(F.array_compact(F.array(*points))))
    counted = rows.groupBy(*keys, "slot", "v").agg(F.count(F.lit(1)).alias("c")).join(unsolved, [*keys, "slot"])
    order = Window.partitionBy(*keys, "slot").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("cum", F.sum("c").over(order) + F.col("below"))
    low = F.min(F.when(F.col("cum") >= F.col("k") + 1, F.col("v")))
    high = F.min(F.when(F.col("cum") >= F.col("k") + 2, F.col("v")))
    picked = ranked.groupBy(*keys, "slot", "n", "k", "f").agg(low.alias("a"), F.coalesce(high, low).alias("b"))
    # Infinite neighbours that are equal must not be subtracted.
    quantile = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))
    return picked.select(*keys, "slot", "n", quantile.alias("quantile")).unionByName(solved)
