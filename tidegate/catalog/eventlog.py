"""Queries over the event log: parsing, alert correlation, flow features, batch decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog import surrogates as S
from tidegate.catalog.registry import register
from tidegate.functions.numbers import finite_or_zero, logistic
from tidegate.models import linear as LI
from tidegate.operators import decisions as OD
from tidegate.operators.cleaning import quoted
from tidegate.plans.bridge import decision_batch_job, score_flows
from tidegate.schemas import FLOW_FEATURES
from tidegate.session import fit_input, scratch_path, stage
from tidegate.sinks.decisions import bulk_lines
from tidegate.sources import event_log as L

WITH = "WITH " + S.PARSED_SQL + " "


def flow_rows(spark, sf):
    return L.flow_events(S.parsed_events(spark, sf))


def alert_rows(spark, sf):
    return L.alert_events(S.parsed_events(spark, sf))


def joined(spark, sf):
    """Flows of the log with their signature."""
    return with_signatures(S.parsed_events(spark, sf))


def with_signatures(events):
    return OD.join_alerts(OD.flow_totals(L.flow_events(events)), OD.alert_index(L.alert_events(events)))


register("scan_eve_batch", lambda spark, sf: _read_log_counts(spark, sf), WITH + """
SELECT 'flow' AS event_type, count(*) AS n FROM parsed_v UNION ALL
SELECT 'alert', count(*) FILTER (signature <> '') FROM parsed_v""")
register("event_type_filter", lambda spark, sf: OD.event_type_filter(S.parsed_events(spark, sf), "alert").select(
    "flow_id", F.col("alert.signature").alias("signature")),
    WITH + "SELECT flow_id, signature FROM parsed_v WHERE signature <> ''")
register("flow_duration_us", lambda spark, sf: OD.flow_duration(flow_rows(spark, sf), ["flow_id"]),
         WITH + "SELECT flow_id, CAST(dur AS DOUBLE) AS duration_us FROM parsed_v")


def _features(spark, sf):
    table = OD.flow_to_features(flow_rows(spark, sf), ["flow_id"])
    return table.select("flow_id", *[F.round(quoted(c), 4).alias(c) for c in FLOW_FEATURES])


_KNOWN = {
    "Flow Duration": "dur", "Total Fwd Packets": "pkts_to", "Total Backward Packets": "pkts_from",
    "Total Length of Fwd Packets": "bytes_to", "Total Length of Bwd Packets": "bytes_from",
    "Flow Bytes/s": "CASE WHEN dur > 0 THEN (bytes_to + bytes_from) / (dur / 1e6) ELSE 0 END",
    "Flow Packets/s": "CASE WHEN dur > 0 THEN (pkts_to + pkts_from) / (dur / 1e6) ELSE 0 END",
    "Fwd Packets/s": "CASE WHEN dur > 0 THEN pkts_to / (dur / 1e6) ELSE 0 END",
    "Bwd Packets/s": "CASE WHEN dur > 0 THEN pkts_from / (dur / 1e6) ELSE 0 END",
    "Average Packet Size": "CASE WHEN pkts_to + pkts_from > 0 THEN (bytes_to + bytes_from) / CAST(pkts_to + pkts_from AS DOUBLE) ELSE 0 END",
    "Packet Length Mean": "CASE WHEN pkts_to + pkts_from > 0 THEN (bytes_to + bytes_from) / CAST(pkts_to + pkts_from AS DOUBLE) ELSE 0 END",
    "Avg Fwd Segment Size": "CASE WHEN pkts_to > 0 THEN bytes_to / CAST(pkts_to AS DOUBLE) ELSE 0 END",
    "Avg Bwd Segment Size": "CASE WHEN pkts_from > 0 THEN bytes_from / CAST(pkts_from AS DOUBLE) ELSE 0 END",
    "Down/Up Ratio": "CASE WHEN pkts_to > 0 THEN pkts_from / CAST(pkts_to AS DOUBLE) ELSE 0 END",
    "Subflow Fwd Packets": "pkts_to", "Subflow Fwd Bytes": "bytes_to",
    "Subflow Bwd Packets": "pkts_from", "Subflow Bwd Bytes": "bytes_from",
    "SYN Flag Count": "CASE WHEN proto = 'TCP' AND event_id % 2 = 0 THEN 1 ELSE 0 END",
    "ACK Flag Count": "CASE WHEN proto = 'TCP' AND event_id % 3 = 0 THEN 1 ELSE 0 END",
    "FIN Flag Count": "CASE WHEN proto = 'TCP' AND event_id % 5 = 0 THEN 1 ELSE 0 END",
}
_FEATURE_SQL = ", ".join(f'round(CAST({_KNOWN.get(c, "0")} AS DOUBLE), 4) AS "{c}"' for c in FLOW_FEATURES)
register("flow_to_features", _features, WITH + f"SELECT flow_id, {_FEATURE_SQL} FROM parsed_v")
register("flow_totals", lambda spark, sf: OD.flow_totals(flow_rows(spark, sf)).select(
    "flow_id", "src_ip", "dst_ip", "dst_port", "proto", "bytes_total", "pkts_total", "age"), WITH + """
SELECT flow_id, src_ip, dst_ip, dst_port, proto, CAST(bytes_to + bytes_from AS DOUBLE) AS bytes_total, pkts_to + pkts_from AS pkts_total,
  floor(duration_us / 1e6) AS age FROM parsed_v""")
register("alert_index", lambda spark, sf: OD.alert_index(alert_rows(spark, sf)),
         WITH + "SELECT flow_id, signature FROM parsed_v WHERE signature <> ''")
register("join_alerts", lambda spark, sf: joined(spark, sf).select("flow_id", "signature", "signature_alert"),
         WITH + "SELECT flow_id, signature, signature <> '' AS signature_alert FROM parsed_v")


def _bulk_lines(spark, sf):
    """All columns of the two-line records, read back from their text."""
    lines = F.split("value", "\n")
    both = bulk_lines(OD.live_records(S.decisions(spark, sf)), "decisions").select(
        F.get_json_object(lines[0], "$.index._index").alias("target"), lines[1].alias("document"))
    return both.select("target", *[F.get_json_object("document", f"$.{c}").alias(c) for c in (
        "flow_id", "src_ip", "dst_ip", "proto", "suricata_signature", "fusion_reason", "verdict")], *[
        F.get_json_object("document", f"$.{c}").cast(kind).alias(c) for c, kind in (
            ("dst_port", "long"), ("bytes_total", "double"), ("pkts_total", "double"), ("duration_ms", "double"),
            ("ml_proba", "double"), ("suricata_alert", "boolean"), ("ml_decision", "boolean"), ("fused_decision", "boolean"))],
        F.get_json_object("document", "$['@timestamp']").alias("stamp"))


register("bulk_ndjson", _bulk_lines, "WITH " + S.DECISIONS_SQL + """
SELECT 'decisions' AS target, CAST(flow_id AS VARCHAR) AS flow_id, src_ip, dst_ip, proto, signature AS suricata_signature, fusion_reason,
  verdict, CAST(dst_port AS BIGINT) AS dst_port, CAST(bytes_total AS DOUBLE) AS bytes_total, CAST(pkts_total AS DOUBLE) AS pkts_total,
  CAST(floor(duration_us / 1e6) AS DOUBLE) AS duration_ms, round(model_proba, 6) AS ml_proba, signature_alert AS suricata_alert,
  model_decision AS ml_decision, fused_decision, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS stamp FROM decisions_v""")


def _landed_alerts(spark, sf):
    """Three alerts a flow in four log files: written late ones have earlier, equal or unreadable times."""
    events = S.table(spark, sf, "events").select("event_id")
    number = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    rows = events.withColumn("k", number).withColumn("file", F.pmod(F.col("event_id"), F.lit(2)) * 2 + F.when(
        F.col("k") == 2, 1).otherwise(0))
    time = F.when((F.col("k") == 2) & (F.col("event_id") % 3 == 0), F.lit("no time")).when(
        F.col("event_id") % 3 == 1, F.lit("2024-01-01T00:00:05Z")).otherwise(
        F.concat(F.lit("2024-01-01T00:00:0"), F.lit(9) - F.col("k"), F.lit("Z")))
    line = F.to_json(F.struct(
        F.lit("alert").alias("event_type"), time.alias("timestamp"), F.col("event_id").cast("string").alias("flow_id"),
        F.struct(F.concat(F.lit("S"), F.col("k")).alias("signature")).alias("alert")))
    path = scratch_path(spark, "alerts")
    ordered = rows.repartition(8, "event_id").sortWithinPartitions("file", "event_id", "k")
    ordered.select(F.format_string("log-%d", "file").alias("name"), line.alias("value")).write.partitionBy("name").text(path)
    return OD.alert_index(L.alert_events(L.read_log(spark, path)))


register("alert_log_order", _landed_alerts, "SELECT CAST(event_id AS VARCHAR) AS flow_id, 'S2' AS signature FROM events")


def _read_log_counts(spark, sf):
    """The log as landed text files, read with the batch scan."""
    path = scratch_path(spark, "log")
    S.log_lines(spark, sf).select("value").write.text(path)
    return L.well_formed(L.read_log(spark, path)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))




def _proxy_probability(features):
    """A fixed logistic score of two flow features, standing in for a fitted model."""
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(quoted("Down/Up Ratio") - F.lit(1.0))))
    return features.withColumn("model_proba", finite_or_zero(score))


def _batch_job(spark, sf):
    from tidegate.plans.bridge import decide

    return decide(S.parsed_events(spark, sf), _proxy_probability).select(
        "flow_id", "model_proba", "signature", "fused_decision", "fusion_reason", "verdict")


register("decision_batch_job", _batch_job, WITH.rstrip() + """,
s AS (SELECT flow_id, signature, 1.0 / (1.0 + exp(-(CASE WHEN pkts_to > 0 THEN pkts_from / CAST(pkts_to AS DOUBLE) ELSE 0 END - 1.0))) AS p FROM parsed_v)
SELECT flow_id, round(p, 6) AS model_proba, signature, signature <> '' OR p >= 0.5 AS fused_decision,
  CASE WHEN signature <> '' AND p >= 0.5 THEN 'suricata+ml' WHEN signature <> '' THEN 'suricata' WHEN p >= 0.5 THEN 'ml' ELSE 'none' END AS fusion_reason,
  CASE WHEN signature <> '' AND p >= 0.5 THEN 'attack_both' WHEN signature <> '' THEN 'attack_suricata_only'
       WHEN p >= 0.5 THEN 'attack_ml_only' ELSE 'benign' END AS verdict FROM s""")


_SCORE_INPUTS = {"packets": "Total Fwd Packets", "replies": "Total Backward Packets", "ratio": "Down/Up Ratio"}


def _signature_scorer(flows):
    """A logistic of three flow features, fitted to whether a flow has a signature, as a scorer."""
    def prepared(features):
        return features.withColumns({n: F.log1p(F.abs(finite_or_zero(quoted(c)))) for n, c in _SCORE_INPUTS.items()})

    inputs = list(_SCORE_INPUTS)
    labelled = flows.withColumn("y", F.col("signature_alert").cast("int"))
    with fit_input(prepared(OD.flow_to_features(labelled, ["y"])).select("y", *inputs), "flow-fit") as rows:
        (weights, intercept), = LI.logistic_fits(rows, [LI.LogisticTask(inputs)])
    return lambda features: prepared(features).withColumn("model_proba", logistic(LI.linear(inputs, [*weights, intercept])))


def _score_flows(spark, sf):
    """Scores of all flows by the fitted model; its intercept has no penalty, so their mean is the rate of signatures."""
    flows = stage(joined(spark, sf), "flows")
    scores = score_flows(flows, _signature_scorer(flows))
    spread = (F.countDistinct(F.round("model_proba", 6)) > 1).alias("varied")
    return scores.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("model_proba"), 6).alias("mean_p"), spread,
        F.count_if(~F.col("model_proba").between(0, 1)).alias("outside"))


register("score_flows", _score_flows, WITH + """
SELECT count(*) AS n, round(avg(CASE WHEN signature <> '' THEN 1.0 ELSE 0.0 END), 6) AS mean_p, true AS varied,
  CAST(0 AS BIGINT) AS outside FROM parsed_v""")


def _fitted_batch_job(spark, sf):
    """The whole job on a landed log: fit, scan, score, join, fuse, store as CSV, read back and count."""
    log = scratch_path(spark, "job-log")
    S.log_lines(spark, sf).select("value").write.text(log)
    scorer = _signature_scorer(stage(with_signatures(L.read_log(spark, log)), "flows"))
    counters = decision_batch_job(spark, log, scorer, scratch_path(spark, "job-decisions"))
    either = F.col("flows") - 2 * F.col("fused") + F.col("alerted") + F.col("model_flagged")
    return counters.select("flows", "alerted", (F.col("agreement") == either).alias("counters_agree"))


register("decision_batch_fitted", _fitted_batch_job, WITH + """
SELECT count(*) AS flows, count(*) FILTER (signature <> '') AS alerted, true AS counters_agree FROM parsed_v""")
