"""Comparison of the two engines over stored decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegate.functions.numbers import ratio


def detection_counts(decisions: DataFrame) -> DataFrame:
    """Flows per engine; the per-engine counts include the flows both engines flag."""
    a, m = F.col("signature_alert"), F.col("model_decision")
    return decisions.agg(
        F.count(F.lit(1)).alias("flows"),
        F.count_if(a).alias("signature_flagged"),
        F.count_if(m).alias("model_flagged"),
        F.count_if(a & m).alias("both"),
        F.count_if(a != m).alias("exactly_one"),
        F.count_if("fused_decision").alias("fused"),
    )


def top_flagged(decisions: DataFrame, k: int = 10) -> DataFrame:
    """Flows with the highest probability; among equals the earlier in the log, or by time where that is not known."""
    wanted = ["ts", "src_ip", "dst_ip", "dst_port", "model_proba", "signature_alert", "fusion_reason"]
    tie_break = [c for c in ("seq", "ts", "flow_id") if c in decisions.columns]
    ordered = decisions.orderBy(F.desc("model_proba"), *tie_break).limit(k)
    return ordered.select([c for c in wanted if c in decisions.columns])


def signature_breakdown(decisions: DataFrame) -> DataFrame:
    alerted = decisions.filter("signature_alert")
    return alerted.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "signature")


def ground_truth_eval(decisions: DataFrame, truth: DataFrame, on: str = "src_ip") -> DataFrame:
    """Precision and recall per engine over the many-to-many join of decisions and truth.

    Only counts are needed, so both sides are reduced to one row per key before they meet:
    the join never expands, whatever share of the rows one key holds. No row when nothing matches.
    """
    engines = {"signature": "signature_alert", "model": "model_decision", "fused": "fused_decision"}
    flagged = [F.count_if(flag).alias(f"{name}_on") for name, flag in engines.items()]
    missed = [F.count_if(~F.col(flag)).alias(f"{name}_off") for name, flag in engines.items()]
    left = decisions.groupBy(on).agg(*flagged, *missed)
    right = truth.groupBy(on).agg(
        F.count_if(F.col("is_attack") == 1).alias("attacks"), F.count_if(F.col("is_attack") == 0).alias("benign")
    )
    cells = [
        F.struct(
            F.lit(name).alias("engine"),
            F.sum(F.col(f"{name}_on") * F.col("attacks")).alias("tp"),
            F.sum(F.col(f"{name}_on") * F.col("benign")).alias("fp"),
            F.sum(F.col(f"{name}_off") * F.col("attacks")).alias("fn"),
        )
        for name in engines
    ]
    summed = left.join(right, on).agg(F.array(*cells).alias("cells"), F.count(F.lit(1)).alias("keys"))
    flat = summed.filter("keys > 0").select(F.inline("cells"))
    return flat.select(
        "engine", "tp", "fp", "fn",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )
