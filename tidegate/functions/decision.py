"""Column expressions that turn a signature and a model probability into one decision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Reason and verdict texts of the decision tables.
REASON_SIGNATURE, REASON_MODEL, REASON_NONE = "suricata", "ml", "none"
VERDICT_BOTH, VERDICT_SIGNATURE, VERDICT_MODEL, VERDICT_BENIGN = (
    "attack_both", "attack_suricata_only", "attack_ml_only", "benign",
)
VERDICTS = [VERDICT_BENIGN, VERDICT_SIGNATURE, VERDICT_MODEL, VERDICT_BOTH]


def has_signature(signature: Column) -> Column:
    """An alert counts only when it carries a signature text."""
    return F.coalesce(signature, F.lit("")) != ""


def at_least(probability: Column, threshold: float | Column) -> Column:
    """The model flags a flow at or above the threshold; an unscored flow is not flagged."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce(probability >= limit, F.lit(False))


def either(alert: Column, flagged: Column) -> Column:
    return alert | flagged


def reason(alert: Column, flagged: Column) -> Column:
    parts = F.concat_ws(
        "+", F.when(alert, F.lit(REASON_SIGNATURE)), F.when(flagged, F.lit(REASON_MODEL))
    )
    return F.when(parts == "", F.lit(REASON_NONE)).otherwise(parts)


def verdict(alert: Column, flagged: Column) -> Column:
    return (
        F.when(alert & flagged, F.lit(VERDICT_BOTH))
        .when(alert, F.lit(VERDICT_SIGNATURE))
        .when(flagged, F.lit(VERDICT_MODEL))
        .otherwise(F.lit(VERDICT_BENIGN))
    )
