"""Batch decisions: event log in, decision table out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.operators import decisions as OD
from tidegate.sinks.decisions import write_decisions_csv
from tidegate.sources import event_log as L
from tidegate.sources.tables import read_decisions_csv

Scorer = Callable[[DataFrame], DataFrame]


def score_flows(flows: DataFrame, scorer: Scorer) -> DataFrame:
    """Flow records with model_proba in place of the parsed counters.

    The scorer gets the 77 features plus `record` and returns them with a model_proba column;
    rows it cannot score end with probability 0.
    """
    carried = [c for c in flows.columns if c not in OD.PARSED_COLUMNS]
    features = OD.flow_to_features(flows.withColumn("record", F.struct(*carried)), ["record"])
    probability = F.coalesce(F.nanvl("model_proba", F.lit(0.0)), F.lit(0.0))
    return scorer(features).select("record.*", probability.alias("model_proba"))


def decide(events: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """Decision frame of a parsed event log."""
    index = OD.alert_index(L.alert_events(events))
    scored = score_flows(OD.flow_totals(L.flow_events(events)), scorer)
    return OD.fuse(OD.join_alerts(scored, index), threshold)


def decision_batch_job(
    spark: SparkSession, log_path: str, scorer: Scorer, out_path: str, threshold: float = 0.5
) -> DataFrame:
    """Reads the log, writes the 12-column table, returns the run counters of the written rows.

    An Observation would save the read, but a session that has one cannot serialise forest models
    that still hold their training summary.
    """
    write_decisions_csv(decide(L.read_log(spark, log_path), scorer, threshold), out_path)
    return OD.run_counters(OD.from_batch_records(read_decisions_csv(spark, out_path)))
