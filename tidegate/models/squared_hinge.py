"""Linear support vector machines with squared hinge loss, by Newton's method on the primal.

Minimises  1/2 |v|^2 + c * sum of weight * max(0, 1 - s (v . x))^2  with s = +1 or -1 and a constant entry for the bias
in x, which is penalised like the others. A step is one aggregate over the rows for all fits together: tasks multiply
the rows inside the margin and hand in a matrix as wide as the features, which Spark adds; the driver solves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Largest gradient entry that ends a fit, as a share of the first one.
TOLERANCE = 1e-9
SUFFICIENT = 1e-4


@dataclass(frozen=True)
class HingeTask:
    """One fit: it leaves out the rows of `fold` (None: none); weights of the two classes."""

    weights: tuple[float, float]
    fold: int | None = None
    c: float = 1.0


@dataclass
class HingeFit:
    point: np.ndarray
    objective: float
    gradient: float
    steps: int

    @property
    def coefficients(self) -> list[float]:
        return [float(v) for v in self.point[:-1]]

    @property
    def intercept(self) -> float:
        return float(self.point[-1])


def _sums(rows: DataFrame, tasks: list[HingeTask], points: dict[int, np.ndarray], width: int) -> dict[int, np.ndarray]:
    """For each point a matrix: Hessian, then gradient and loss of the data part in the last column."""
    size = width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {k: np.zeros((size + 1, size + 1)) for k in points}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            fold, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sign = np.where(y > 0, 1.0, -1.0)
            for k, point in points.items():
                task = tasks[k]
                gap = 1.0 - sign * (x @ point)
                inside = (gap > 0) if task.fold is None else (gap > 0) & (fold != task.fold)
                part, g, s = x[inside], gap[inside], sign[inside]
                weight = task.c * np.where(s > 0, task.weights[1], task.weights[0])
                out[k][:size, :size] += 2.0 * (part * weight[:, None]).T @ part
                out[k][:size, size] -= 2.0 * part.T @ (weight * g * s)
                out[k][size, size] += float((weight * g * g).sum())
        for k, matrix in out.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * (size + 1), pa.int32()), pa.array(range(size + 1), pa.int32()),
                 pa.array(list(matrix), pa.list_(pa.float64()))], ["task", "i", "row"])

    parts = rows.select("fold", "y", "_x").mapInArrow(run, "task int, i int, row array<double>")
    cells = parts.select("task", "i", F.posexplode("row").alias("j", "v")).groupBy("task", "i", "j").agg(F.sum("v").alias("v"))
    found = {k: np.zeros((size + 1, size + 1)) for k in points}
    for r in cells.collect():
        found[r.task][r.i, r.j] = r.v
    return found


def squared_hinge_fits(rows: DataFrame, tasks: list[HingeTask], width: int, max_iter: int = 3000) -> list[HingeFit]:
    """Fits of all tasks; `rows` (fold, y, _x array of `width` doubles) should be cached.

    Newton steps with halving: a point is kept if its objective falls by a share of what its gradient promises. The loss
    is convex and once differentiable, its second derivative changes only where rows cross the margin, so few steps end
    at a gradient of zero.
    """
    size = width + 1
    tried = {k: np.zeros(size) for k in range(len(tasks))}
    kept: dict[int, HingeFit] = {}
    moves: dict[int, tuple[np.ndarray, float]] = {}
    first: dict[int, float] = {}
    for step in range(max_iter + 1):
        if not tried:
            break
        sums = _sums(rows, tasks, tried, width)
        for k, matrix in sums.items():
            point = tried[k]
            objective = 0.5 * float(point @ point) + float(matrix[size, size])
            gradient = point + matrix[:size, size]
            if k in kept:
                move, slope = moves[k]
                if objective > kept[k].objective + SUFFICIENT * slope + 1e-13 * abs(kept[k].objective):
                    move, slope = 0.5 * move, 0.5 * slope
                    if np.abs(move).max() <= 1e-15 * (1.0 + np.abs(kept[k].point).max()):
                        del tried[k]
                        continue
                    moves[k], tried[k] = (move, slope), kept[k].point + move
                    continue
            largest = float(np.abs(gradient).max())
            kept[k] = HingeFit(point, objective, largest, step)
            if largest <= TOLERANCE * max(first.setdefault(k, largest), 1e-300):
                del tried[k]
                continue
            move = -np.linalg.solve(matrix[:size, :size] + np.eye(size), gradient)
            moves[k], tried[k] = (move, float(gradient @ move)), point + move
    return [kept[k] for k in range(len(tasks))]
