"""Balanced class weights, small logistic fits and the calibrated linear support vector baseline."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.functions.numbers import array_dot, dot, group_dot, logistic, number
from tidegate.models.squared_hinge import HingeTask, squared_hinge_fits
from tidegate.operators.sampling import stratified_folds
from tidegate.session import fit_input


def with_array(df: DataFrame, vector: str = "features", name: str = "_x") -> DataFrame:
    """The entries of a vector column as an array column."""
    return df.withColumn(name, vector_to_array(F.col(vector)))


@dataclass(frozen=True)
class LogisticTask:
    """One logistic fit on a few columns: ridge strength c (None: no penalty), rows and row weights as SQL."""

    inputs: list[str]
    c: float | None = 1.0
    where: str = "true"
    weight: str = "1D"


def logistic_fits(df: DataFrame, tasks: list[LogisticTask], max_iter: int = 50, tolerance: float = 1e-9):
    """Newton's method for several small logistic fits at once.

    Each step is one aggregate that sums loss, gradient and Hessian of every fit, so the number
    of passes does not grow with the number of fits. Returns (coefficients, intercept) per task.
    """
    return grouped_logistic_fits(df, tasks, 1, None, max_iter, tolerance)[0]


def grouped_logistic_fits(
    df: DataFrame, tasks: list[LogisticTask], groups: int, by: str | None, max_iter: int = 50, tolerance: float = 1e-9
):
    """`logistic_fits` on the rows of every group, in common passes; `by` numbers the groups from 0 (None: one of all rows)."""
    names = [(g, i) for g in range(groups) for i in range(len(tasks))]
    points = {k: np.zeros(len(tasks[k[1]].inputs) + 1) for k in names}
    accepted = {k: (p, np.inf) for k, p in points.items()}
    ridge = [np.array([0.0 if t.c is None else 1.0 / t.c] * len(t.inputs) + [0.0]) for t in tasks]
    active = set(names)
    for _ in range(max_iter):
        order = sorted({i for _, i in active})
        scored = df.withColumns({
            f"_z{i}": linear(tasks[i].inputs, [points[g, i] for g in range(groups)] if by else points[0, i], by) for i in order})
        scored = scored.withColumns({f"_p{i}": logistic(F.col(f"_z{i}")) for i in order})
        sums = F.array(*[_newton_sums(tasks[i], i) for i in order]).alias("s")
        found = {r.g: r.s for r in scored.groupBy(F.col(by).alias("g")).agg(sums).collect()} if by else {0: scored.agg(sums).first().s}
        active &= {(g, i) for g in found for i in order}
        for k, values in [((g, i), v) for g, s in found.items() for i, v in zip(order, s, strict=True) if (g, i) in active]:
            size = len(tasks[k[1]].inputs) + 1
            loss = values[0] + 0.5 * float(ridge[k[1]] @ points[k] ** 2)
            best, best_loss = accepted[k]
            if loss > best_loss + 1e-12 * abs(best_loss):
                points[k] = 0.5 * (points[k] + best)
                if np.max(np.abs(points[k] - best)) < tolerance:
                    active.discard(k)
                continue
            gradient = np.array(values[1 : 1 + size]) + ridge[k[1]] * points[k]
            hessian = np.diag(ridge[k[1]])
            hessian[np.triu_indices(size)] += values[1 + size :]
            hessian = np.triu(hessian) + np.triu(hessian, 1).T
            accepted[k] = (points[k], loss)
            step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            points[k] = points[k] - step
            if np.max(np.abs(step)) <= tolerance * (1.0 + np.max(np.abs(points[k]))) or best_loss - loss < 1e-13 * abs(loss):
                active.discard(k)
        if not active:
            break
    fitted = {k: ([float(v) for v in p[:-1]], float(p[-1])) for k, (p, _) in accepted.items()}
    return [[fitted[g, i] for i in range(len(tasks))] for g in range(groups)]


def linear(inputs: list[str], point, by: str | None = None) -> Column:
    """Weighted sum of columns plus the intercept, the last entry of `point`; with `by`, one point for each group."""
    if by:
        return group_dot([*inputs, "1D"], point, by)
    return array_dot(f"array({', '.join([*inputs, '1D'])})", point)


def _newton_sums(task: LogisticTask, place: int) -> Column:
    """[loss, gradient..., upper triangle of the Hessian...] as one array of sums."""
    x, z, p = [*task.inputs, "1D"], f"_z{place}", f"_p{place}"
    terms = [f"greatest({z}, 0D) + log1p(exp(-abs({z}))) - y * {z}", *[f"({p} - y) * {c}" for c in x]]
    terms += [f"{p} * (1D - {p}) * {x[a]} * {x[b]}" for a in range(len(x)) for b in range(a, len(x))]
    weight = f"(CASE WHEN {task.where} THEN {task.weight} ELSE 0D END)"
    return F.expr("array(" + ", ".join(f"coalesce(sum({weight} * ({t})), 0D)" for t in terms) + ")")


def platt_task(n0: int, n1: int, score: str = "score", where: str = "true") -> LogisticTask:
    """Platt's sigmoid on rows of `with_platt_targets`: each row enters once per class."""
    target = f"(CASE WHEN _label = 1 THEN {number((n1 + 1.0) / (n1 + 2.0))} ELSE {number(1.0 / (n0 + 2.0))} END)"
    return LogisticTask([score], None, where, f"(CASE WHEN y = 1 THEN {target} ELSE 1D - {target} END)")


def with_platt_targets(scored: DataFrame) -> DataFrame:
    """Two rows per row: class 1 weighted by the smoothed target t, class 0 by 1 - t."""
    return scored.withColumnRenamed("y", "_label").withColumn("y", F.explode(F.array(F.lit(1.0), F.lit(0.0))))


@dataclass(frozen=True)
class CalibratedSvc:
    """Fold members (weights, bias, slope, intercept); the probability is their mean."""

    members: list[tuple[list[float], float, float, float]]

    def transform(self, df: DataFrame, output: str = "p") -> DataFrame:
        parts = [logistic(F.lit(a) * (dot("_x", w) + F.lit(b)) + F.lit(c)) for w, b, a, c in self.members]
        mean = sum(parts[1:], parts[0]) / F.lit(float(len(parts)))
        return with_array(df).withColumn(output, mean).drop("_x")


def class_weights(n0: int, n1: int) -> tuple[float, float]:
    """n / (2 * class size) of both classes."""
    return (n0 + n1) / (2.0 * max(n0, 1)), (n0 + n1) / (2.0 * max(n1, 1))


def fit_linear_svc(
    train: DataFrame, c: float = 1.0, max_iter: int = 3000, seed: int = 42, folds: int = 3
) -> CalibratedSvc:
    """Linear SVM (squared hinge) per fold with balanced weights, calibrated on the rows left out.

    Expects row_id, features, y. All folds are fitted together.
    """
    rows = with_array(stratified_folds(train.select("row_id", "features", "y"), folds, seed, key=["row_id"]))
    with fit_input(rows.select("fold", "y", "_x")) as split:
        found = split.groupBy("fold").agg(
            F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"),
            F.max(F.size("_x")).alias("width")).collect()
        sizes = {r.fold: (r.n0, r.n1) for r in found}
        total = np.sum(list(sizes.values()), axis=0)
        tasks = [HingeTask(class_weights(*(int(v) for v in total - np.array(sizes.get(fold, (0, 0))))), fold, c)
                 for fold in range(folds)]
        fits = squared_hinge_fits(split, tasks, max(r.width for r in found), max_iter)
        score = F.lit(None).cast("double")
        for fold, fit in enumerate(fits):
            score = F.when(F.col("fold") == fold, dot("_x", fit.coefficients) + F.lit(fit.intercept)).otherwise(score)
        left_out = with_platt_targets(split.select("fold", "y", score.alias("score")))
        sigmoids = logistic_fits(left_out, [
            platt_task(*sizes.get(fold, (0, 0)), where=f"fold = {fold}") for fold in range(folds)])
    return CalibratedSvc([
        (fit.coefficients, fit.intercept, slope[0], intercept)
        for fit, (slope, intercept) in zip(fits, sigmoids, strict=True)])
