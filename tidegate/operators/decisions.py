"""Alert correlation, scoring hand-over and decision fusion over whole frames.

The decision frame has the columns
ts, flow_id, src_ip, dst_ip, dst_port, proto, bytes_total, pkts_total, age,
signature, model_proba, signature_alert, model_decision, fused_decision, fusion_reason, verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidegate.functions import decision as D
from tidegate.functions import flow as FL
from tidegate.functions.numbers import ratio
from tidegate.schemas import DECISION_BATCH, DECISION_LIVE

NULL_KEY_SALTS = 64
# Columns of a parsed record that only the feature expressions read.
PARSED_COLUMNS = ("flow", "tcp", "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", "start", "end")


def event_type_filter(events: DataFrame, event_type: str) -> DataFrame:
    return events.filter(F.col("event_type") == event_type)


def alert_index(alerts: DataFrame) -> DataFrame:
    """One signature per flow: the last alert in log order; alerts without a flow are ignored.

    Expects flow_id, signature and `seq`, the position in the log. Times do not count: a later line wins even if its
    time is earlier or cannot be read.
    """
    newest = F.max_by(F.coalesce("signature", F.lit("")), F.struct("seq"))
    return alerts.filter(F.col("flow_id").isNotNull()).groupBy("flow_id").agg(newest.alias("signature"))


def join_alerts(flows: DataFrame, index: DataFrame) -> DataFrame:
    """Flows with their signature ('' when there is none) and the alert flag.

    Flows without an id match nothing; a second join key spreads them over the partitions
    instead of sending all of them to the one that holds the null key.
    """
    spread = F.when(
        F.col("flow_id").isNull(),
        F.lit(1) + F.pmod(F.xxhash64("ts", "src_ip", "dst_ip"), F.lit(NULL_KEY_SALTS)),
    ).otherwise(F.lit(0))
    left = flows.withColumn("_spread", spread.cast("int"))
    right = index.select("flow_id", "signature", F.lit(0).alias("_spread"))
    joined = left.join(right, ["flow_id", "_spread"], "left").drop("_spread")
    joined = joined.withColumn("signature", F.coalesce("signature", F.lit("")))
    return joined.withColumn("signature_alert", D.has_signature(F.col("signature")))


def flow_totals(flows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed flow columns of a parsed event log, with totals and defaults filled in, and the `keep` columns."""
    default_time = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    stamp = F.coalesce(F.when(F.col("timestamp") != "", F.col("timestamp")), default_time)
    return flows.select(
        F.coalesce(FL.iso_timestamp(stamp), F.current_timestamp()).alias("ts"),
        stamp.alias("timestamp"),
        "flow_id",
        *[F.coalesce(name, F.lit("")).alias(alias)
          for name, alias in (("src_ip", "src_ip"), ("dest_ip", "dst_ip"), ("proto", "proto"))],
        F.coalesce(F.col("dest_port").try_cast("int"), F.lit(0)).alias("dst_port"),
        F.coalesce("dest_port", F.lit("")).alias("dst_port_text"),
        (FL.counter("bytes_toserver") + FL.counter("bytes_toclient")).alias("bytes_total"),
        (FL.counter("pkts_toserver").cast("long") + FL.counter("pkts_toclient").cast("long")).alias("pkts_total"),
        FL.counter("age").alias("age"),
        *[c for c in flows.columns if c == "seq" or c in PARSED_COLUMNS or c in keep],
    )


def flow_to_features(flows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The 77 feature columns of parsed flow records, after the `keep` columns."""
    keep = keep or []
    staged = flows.select(
        *keep, *[expr.alias(name) for name, expr in FL.base_columns().items()], F.col("tcp")
    )
    return staged.select(*keep, *FL.feature_columns())


def flow_duration(flows: DataFrame, keep: list[str]) -> DataFrame:
    return flows.select(*keep, FL.duration_us(FL.flow_field("start"), FL.flow_field("end")).alias("duration_us"))


def fuse(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Decision columns from signature and model_proba.

    The threshold sees the unrounded probability; the stored one has 6 places.
    """
    alert = D.has_signature(F.col("signature"))
    probability = F.coalesce("model_proba", F.lit(0.0))
    flagged = D.at_least(probability, threshold)
    staged = scored.withColumns({"signature_alert": alert, "model_decision": flagged})
    alert, flagged = F.col("signature_alert"), F.col("model_decision")
    return staged.withColumns({
        "model_proba": F.round(probability, 6),
        "fused_decision": D.either(alert, flagged),
        "fusion_reason": D.reason(alert, flagged),
        "verdict": D.verdict(alert, flagged),
    })


def threshold_decision(scored: DataFrame, threshold: float = 0.5, column: str = "p") -> DataFrame:
    return scored.withColumn("yhat", D.at_least(F.col(column), threshold).cast("int"))


def counter_columns() -> list:
    """Run counters as aggregates, also usable with `observe`."""
    both_same = F.col("signature_alert") == F.col("model_decision")
    return [
        F.count(F.lit(1)).alias("flows"),
        F.count_if("signature_alert").alias("alerted"),
        F.count_if("model_decision").alias("model_flagged"),
        F.count_if("fused_decision").alias("fused"),
        F.count_if(both_same).alias("agreement"),
    ]


def with_agreement(counters: DataFrame) -> DataFrame:
    percent = F.round(100 * ratio(F.col("agreement"), F.col("flows"), empty=None), 1)
    return counters.withColumn("agreement_pct", percent)


def run_counters(decisions: DataFrame) -> DataFrame:
    """Flows, flagged per engine, fused, and how often both engines say the same."""
    return with_agreement(decisions.agg(*counter_columns()))


def batch_records(decisions: DataFrame) -> DataFrame:
    """The 12-column 0/1 layout."""
    port = F.col("dst_port_text") if "dst_port_text" in decisions.columns else F.col("dst_port")
    stamp = F.col("timestamp") if "timestamp" in decisions.columns else iso_text(F.col("ts"))
    values = {
        "timestamp": stamp, "src_ip": F.col("src_ip"), "dst_ip": F.col("dst_ip"), "dst_port": port,
        "proto": F.col("proto"), "bytes_total": F.col("bytes_total"),
        "suricata_alert": F.col("signature_alert"), "suricata_signature": F.col("signature"),
        "ml_proba": F.col("model_proba"), "ml_decision": F.col("model_decision"),
        "fused_decision": F.col("fused_decision"), "fusion_reason": F.col("fusion_reason"),
    }
    return decisions.select([values[f.name].cast(f.dataType).alias(f.name) for f in DECISION_BATCH])


def live_records(decisions: DataFrame) -> DataFrame:
    """The 16-column boolean layout; duration_ms carries the record's age in seconds, as published."""
    stamp = F.col("timestamp") if "timestamp" in decisions.columns else iso_text(F.col("ts"))
    values = {
        "@timestamp": stamp, "flow_id": F.coalesce("flow_id", F.lit("")), "src_ip": F.col("src_ip"),
        "dst_ip": F.col("dst_ip"), "dst_port": F.col("dst_port"), "proto": F.col("proto"),
        "bytes_total": F.col("bytes_total"), "pkts_total": F.col("pkts_total"), "duration_ms": F.col("age"),
        "suricata_alert": F.col("signature_alert"), "suricata_signature": F.col("signature"),
        "ml_proba": F.col("model_proba"), "ml_decision": F.col("model_decision"),
        "fused_decision": F.col("fused_decision"), "fusion_reason": F.col("fusion_reason"),
        "verdict": F.col("verdict"),
    }
    return decisions.select([values[f.name].cast(f.dataType).alias(f.name) for f in DECISION_LIVE])


def iso_text(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def from_batch_records(records: DataFrame) -> DataFrame:
    """A stored 12-column table back as a decision frame."""
    alert, flagged = F.col("suricata_alert") == 1, F.col("ml_decision") == 1
    return records.select(
        F.try_to_timestamp("timestamp").alias("ts"), "timestamp", "src_ip", "dst_ip",
        F.coalesce(F.col("dst_port").try_cast("int"), F.lit(0)).alias("dst_port"), "proto", "bytes_total",
        alert.alias("signature_alert"), F.coalesce("suricata_signature", F.lit("")).alias("signature"),
        F.col("ml_proba").alias("model_proba"), flagged.alias("model_decision"),
        (F.col("fused_decision") == 1).alias("fused_decision"), "fusion_reason",
        D.verdict(alert, flagged).alias("verdict"),
    )
