"""Metrics of a 2x2 confusion table as column expressions over tp, fp, tn, fn."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidegate.functions.numbers import ratio


def _counts() -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(name).cast("double") for name in ("tp", "fp", "tn", "fn"))


def precision() -> Column:
    tp, fp, _, _ = _counts()
    return ratio(tp, tp + fp)


def recall() -> Column:
    tp, _, _, fn = _counts()
    return ratio(tp, tp + fn)


def false_positive_rate() -> Column:
    _, fp, tn, _ = _counts()
    return ratio(fp, fp + tn)


def false_negative_rate() -> Column:
    tp, _, _, fn = _counts()
    return ratio(fn, fn + tp)


def accuracy() -> Column:
    tp, fp, tn, fn = _counts()
    return ratio(tp + tn, tp + fp + tn + fn, empty=None)


def macro_f1() -> Column:
    """Mean F1 over the classes that occur among labels or predictions."""
    tp, fp, tn, fn = _counts()
    errors = fp + fn
    attack = F.try_divide(2 * tp, 2 * tp + errors)
    benign = F.try_divide(2 * tn, 2 * tn + errors)
    present = attack.isNotNull().cast("int") + benign.isNotNull().cast("int")
    return ratio(F.coalesce(attack, F.lit(0.0)) + F.coalesce(benign, F.lit(0.0)), present, empty=None)


def mcc() -> Column:
    """Matthews correlation; 0 when a row or column of the table is empty.

    The root is taken per factor so that the product cannot overflow.
    """
    tp, fp, tn, fn = _counts()
    scale = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return ratio(tp * tn - fp * fn, scale)
