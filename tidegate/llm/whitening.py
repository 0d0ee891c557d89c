"""Whitening of embeddings by the covariance of their distinct quantised vectors.

Vectors are quantised, identical ones grouped, and each distinct one enters the covariance once, with weight one or
with its number of rows. Tasks multiply their centred vectors and hand in one matrix each; Spark adds the matrices,
and only a matrix of the vectors' width reaches the driver, which finds the components. Each distinct vector is
whitened once and joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.llm.heavy import lookup
from tidegate.llm.staging import Stage

SCALE = 256
COMPONENTS = 4
#: Rows that a task multiplies at a time.
BLOCK = 4096


@dataclass(frozen=True)
class Whitening:
    """A fit: `n` weights in all, per-dimension `sums`, unit components in columns by falling eigenvalue, trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(len(self.sums))

    def explained(self, component: int) -> float | None:
        return float(self.eigenvalues[component] / self.trace) if self.trace > 0 else None


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Entries times `scale`, rounded down, as longs (beyond the range of longs: the nearest long)."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def finite_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, x) with a vector that is not null and has only finite entries."""
    bad = F.exists(vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = df.filter(F.col(vector_col).isNotNull()).filter(~bad)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter ones are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.repeat(np.arange(len(lengths)), lengths),
        np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors and weights, in blocks; columns are (vector, weight)."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield _matrix(part.column(0), width), part.column(1).to_numpy(zero_copy_only=False)


def weighted_sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """Total weight and exact weighted sums per dimension of long vectors; columns are (vector, weight)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, [0] * width
        for x, w in _blocks(batches, width):
            total += int(w.sum())
            small = len(x) == 0 or float(np.abs(x.astype(float)).max(initial=0)) * float(w.sum()) < 2 ** 62
            part = (x * w[:, None]).sum(0) if small else (x.astype(object) * w.astype(object)[:, None]).sum(0)
            sums = [a + int(b) for a, b in zip(sums, part, strict=True)]
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(-1, width), pa.int32()), "v": pa.array([str(v) for v in [total, *sums]])})

    parts = vectors.mapInArrow(run, "i int, v string")
    found = {r.i: int(r.s) for r in parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def covariance(vectors: DataFrame, width: int, centre: np.ndarray, total: float) -> np.ndarray:
    """Weighted covariance (divisor `total`) of vectors centred before they are multiplied; columns (vector, weight).

    A task hands in one matrix, row by row; Spark adds the rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width))
        for x, w in _blocks(batches, width):
            c = x.astype(float) - centre
            gram += (c * w[:, None]).T @ c
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(width), pa.int32()), "row": pa.array(list(gram), pa.list_(pa.float64()))})

    parts = vectors.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v / total
    return (out + out.T) / 2


def components_of(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns, each with its largest entry positive."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1].clip(min=0), vectors[:, ::-1]
    if len(values):
        most = np.abs(vectors).argmax(0)
        vectors = vectors * np.where(vectors[most, np.arange(len(values))] < 0, -1.0, 1.0)
        # what is left of directions without any variance is rounding
        values = np.where(values > len(values) * np.finfo(float).eps * values[0], values, 0.0)
    return values, vectors


def _whitener(fit: Whitening, width: int, count: int):
    """Function of batches (x, copies): adds whitened values and the exact squared deviation as text."""
    root = np.sqrt(fit.eigenvalues[:count])
    turn = fit.components[:, :count] / np.where(root > 0, root, np.nan)
    mean, n, sums = fit.mean, fit.n, fit.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x = _matrix(part.column(0), width)
                white = (x.astype(float) - mean) @ turn
                reach = float(n) * float(np.abs(x.astype(float)).max(initial=0)) + max([abs(s) for s in sums], default=0)
                if width * reach ** 2 < 2 ** 62:
                    away = ((n * x - np.array(sums, np.int64)) ** 2).sum(1)
                else:
                    away = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
                cells = pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel()))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * count, pa.int32()), cells),
                    pa.array([str(v) for v in away], pa.string())], ["x", "copies", "whitened", "away"])

    return run


def whiten(df: DataFrame, components: int = COMPONENTS, weights: str = "one", scale: int = SCALE,
           id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening]:
    """Rows with whitened vectors, and the fit.

    Returns vec_id, x (array of long), whitened (array of double, one entry a component), deviation (decimal: sum over
    dimensions of (n x - S)^2, exact; null beyond 38 digits), a row for each row of `df` that has a usable vector, in
    no order. `weights` is "one" (each distinct x counts once) or "count" (as often as it occurs). Null vectors and those with
    null, infinite or NaN entries are left out; a null id stays as it is; equal rows stay as often as they are there;
    vectors shorter than the longest are filled up with zeros; whitened is null for components without variance. An
    empty table gives no rows. Other columns of `df` are not looked at. Tables of the distinct vectors stay in the
    checkpoint folder, as the result reads them.
    """
    rows = finite_vectors(df, id_col, vector_col, scale)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    rows = rows.select("vec_id", F.when(F.size("x") < width, filled).otherwise(F.col("x")).alias("x"))
    distinct = Stage(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "vectors")
    weight = F.lit(1).cast("long") if weights == "one" else F.col("copies")
    listed = distinct.read().select("x", weight.alias("w"))
    n, sums = weighted_sums(listed, width)
    plain = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    matrix = covariance(listed, width, plain.mean, max(n, 1))
    values, vectors = components_of(matrix)
    count = min(components, width)
    fit = Whitening(n, sums, vectors, values, float(np.trace(matrix)))
    white = distinct.read().select("x", "copies").mapInArrow(
        _whitener(fit, width, count), "x array<long>, copies long, whitened array<double>, away string")
    white = white.withColumn("deviation", F.col("away").try_cast("decimal(38,0)")).drop("away")
    done = Stage(white, "whitened")
    distinct.drop()
    live = int((values[:count] > 0).sum())
    error = None
    if live:
        kept = done.read().select(F.slice("whitened", 1, live).alias("v"), weight.alias("w"))
        error = float(np.abs(covariance(kept, live, _mean(kept, live, n), n) - np.eye(live)).max())
    fit = Whitening(n, sums, vectors, values, fit.trace, error)
    back = lookup(rows, done.read(), ["x"], "copies", ["whitened", "deviation"])
    return back.select("vec_id", "x", "whitened", "deviation"), fit


def _mean(vectors: DataFrame, width: int, total: int) -> np.ndarray:
    row = vectors.agg(*[F.sum(F.get("v", F.lit(i)) * F.col("w")).alias(f"m{i}") for i in range(width)]).first()
    return np.array([v / total for v in row])


def by_component(whitened: DataFrame, fit: Whitening, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    parts = [F.struct(F.lit(i + 1).alias("component"), F.get("whitened", F.lit(i)).alias("whitened"),
                      F.lit(fit.explained(i)).cast("double").alias("explained"))
             for i in range(min(components, len(fit.sums)))]
    none = "array<struct<component:int,whitened:double,explained:double>>"
    each = F.explode(F.array(*parts).cast(none)).alias("c")
    return whitened.select("vec_id", "deviation", each).select(
        "vec_id", "c.component", F.lit(fit.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained",
        F.lit(fit.identity_error).cast("double").alias("identity_error"))
