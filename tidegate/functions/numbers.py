"""Numeric clean-up, guarded arithmetic and binning expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed value: the largest finite single-precision number.
FLOAT32_MAX = 3.4028234663852886e38


def to_number(column: Column) -> Column:
    """Text to double; anything that is not a number becomes null."""
    return F.trim(column.cast("string")).try_cast("double")


def is_infinite(column: Column) -> Column:
    return F.abs(column) == F.lit(float("inf"))


def finite_or_null(column: Column) -> Column:
    return F.when(~is_infinite(column) & ~F.isnan(column), column)


def single_precision(column: Column) -> Column:
    """Missing becomes 0, infinities become the largest float, the rest is rounded to float."""
    value = F.coalesce(F.nanvl(column.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.least(value, F.lit(FLOAT32_MAX)), F.lit(-FLOAT32_MAX)).cast("float")


def finite_or_zero(column: Column) -> Column:
    return F.coalesce(finite_or_null(column.cast("double")), F.lit(0.0))


def ratio(numerator: Column, denominator: Column, empty: float | None = 0.0) -> Column:
    """Division that yields `empty` when the denominator is 0."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def unit_interval_edges(n_bins: int) -> list[float]:
    """The n+1 edges i * (1/n), with exactly 1 at the end, as doubles."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def bin_by_edges(value: Column, edges: list[float]) -> Column:
    """Index of the right-open bin holding `value`, clipped into the first and last bin."""
    index = F.lit(0)
    for position, edge in enumerate(edges[1:-1], start=1):
        index = F.when(value >= F.lit(edge), F.lit(position)).otherwise(index)
    return index


def logistic(column: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-column))


def number(value: float) -> str:
    """A double literal as SQL text."""
    return f"{float(value)!r}D"


def dot(array: str, weights) -> Column:
    """Dot product of an array column and fixed weights as one code-generated expression."""
    return F.expr(" + ".join(["0D", *[f"{array}[{i}] * {number(w)}" for i, w in enumerate(weights)]]))


def doubles(values) -> str:
    """An array of double literals as SQL text."""
    return f"array({', '.join(number(v) for v in values)})"


def array_dot(array: str, weights) -> Column:
    """Dot product of an array (SQL text) with weights that change from step to step.

    The weights are data of the expression, not part of its generated code, so an iterative fit
    does not compile a new class per step.
    """
    return F.expr(f"aggregate(zip_with({array}, {doubles(weights)}, (a, b) -> a * b), 0D, (s, v) -> s + v)")


def group_dot(entries: Sequence[str], weights, by: str) -> Column:
    """Dot product of columns (SQL text) with the weights of the row's group; `by` numbers the groups from 0.

    Weights of an entry are one array, which is data of the generated code as well.
    """
    listed = [f"{x} * {doubles(w)}[{by}]" for x, w in zip(entries, zip(*weights, strict=True), strict=True)]
    return F.expr(" + ".join(["0D", *listed]))
