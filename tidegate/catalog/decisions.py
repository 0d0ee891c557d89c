"""Queries over decisions: fusion, report, dashboards, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog import surrogates as S
from tidegate.catalog.registry import register
from tidegate.functions.decision import VERDICTS
from tidegate.operators import dashboards as DB
from tidegate.operators import decisions as OD
from tidegate.operators import report as RP
from tidegate.operators import rules as RU

WITH = "WITH " + S.DECISIONS_SQL + " "
TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def text_time(df, column="ts"):
    return df.withColumn(column, F.date_format(column, TS_TEXT))


SQL_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def on_decisions(fn):
    return lambda spark, sf: fn(S.decisions(spark, sf))


# ---- fusion -----------------------------------------------------------------
register("fuse_decision", on_decisions(lambda d: d.select("flow_id", "signature_alert", "model_decision", "fused_decision")),
         WITH + "SELECT flow_id, signature_alert, model_decision, fused_decision FROM decisions_v")
register("fusion_reason", on_decisions(lambda d: d.select("flow_id", "fusion_reason")),
         WITH + "SELECT flow_id, fusion_reason FROM decisions_v")
register("verdict", on_decisions(lambda d: d.select("flow_id", "verdict")), WITH + "SELECT flow_id, verdict FROM decisions_v")
register("run_counters", on_decisions(OD.run_counters), WITH + """
SELECT count(*) AS flows, count(*) FILTER (signature_alert) AS alerted, count(*) FILTER (model_decision) AS model_flagged,
  count(*) FILTER (fused_decision) AS fused, count(*) FILTER (signature_alert = model_decision) AS agreement,
  round(100.0 * count(*) FILTER (signature_alert = model_decision) / count(*), 1) AS agreement_pct FROM decisions_v""")
register("engine_agreement", lambda spark, sf: OD.run_counters(S.engines(spark, sf)), """
SELECT count(*) AS flows, count(*) FILTER (toxic = 1) AS alerted, count(*) FILTER (quality = 0) AS model_flagged,
  count(*) FILTER (toxic = 1 OR quality = 0) AS fused, count(*) FILTER ((toxic = 1) = (quality = 0)) AS agreement,
  round(100.0 * count(*) FILTER ((toxic = 1) = (quality = 0)) / count(*), 1) AS agreement_pct FROM labels""")
register("decision_schema", lambda spark, sf: OD.live_records(S.decisions(spark, sf)), WITH + """
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS "@timestamp", flow_id, src_ip, dst_ip, dst_port, proto, bytes_total,
  pkts_total, floor(duration_us / 1e6) AS duration_ms, signature_alert AS suricata_alert, signature AS suricata_signature,
  round(model_proba, 6) AS ml_proba, model_decision AS ml_decision, fused_decision, fusion_reason, verdict FROM decisions_v""")

# ---- comparison report --------------------------------------------------------
register("detection_counts", on_decisions(RP.detection_counts), WITH + """
SELECT count(*) AS flows, count(*) FILTER (signature_alert) AS signature_flagged, count(*) FILTER (model_decision) AS model_flagged,
  count(*) FILTER (signature_alert AND model_decision) AS both, count(*) FILTER (signature_alert <> model_decision) AS exactly_one,
  count(*) FILTER (fused_decision) AS fused FROM decisions_v""")
register("top_flagged", on_decisions(lambda d: text_time(RP.top_flagged(d))), WITH + f"""
SELECT {SQL_TS.format('ts')} AS ts, src_ip, dst_ip, dst_port, model_proba, signature_alert, fusion_reason FROM decisions_v
ORDER BY model_proba DESC, decisions_v.ts, flow_id LIMIT 10""")
register("signature_breakdown", on_decisions(RP.signature_breakdown), WITH + """
SELECT signature, count(*) AS n FROM decisions_v WHERE signature_alert GROUP BY signature""")
_GT = ["precision", "recall"]
register("ground_truth_eval", lambda spark, sf: RP.ground_truth_eval(S.decisions(spark, sf), S.truth(spark, sf)).withColumns(
    {c: F.round(c, 6) for c in _GT}), WITH.rstrip() + "," + S.TRUTH_SQL + """,
joined AS (SELECT d.signature_alert, d.model_decision, d.fused_decision, t.is_attack FROM
  (SELECT src_ip, signature_alert, model_decision, fused_decision FROM decisions_v) d JOIN truth_v t ON d.src_ip = t.src_ip),
long AS (SELECT 'signature' AS engine, signature_alert AS flag, is_attack FROM joined
  UNION ALL SELECT 'model', model_decision, is_attack FROM joined UNION ALL SELECT 'fused', fused_decision, is_attack FROM joined),
c AS (SELECT engine, count(*) FILTER (flag AND is_attack = 1) AS tp, count(*) FILTER (flag AND is_attack = 0) AS fp,
  count(*) FILTER (NOT flag AND is_attack = 1) AS fn FROM long GROUP BY engine)
SELECT engine, tp, fp, fn, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall FROM c""")

# ---- dashboards -----------------------------------------------------------------


def top_sql(column, k, where="true", shown=None):
    return WITH + (f"SELECT {shown or column} AS {column}, n FROM (SELECT {column}, count(*) AS n FROM decisions_v "
                   f"WHERE {where} GROUP BY {column} ORDER BY n DESC, {column} LIMIT {k}) t")


register("verdict_breakdown", on_decisions(DB.verdict_breakdown), top_sql("verdict", 5))
register("top_attackers", on_decisions(DB.top_attackers), top_sql("src_ip", 15, "fused_decision"))
register("signature_hits", on_decisions(DB.signature_hits), top_sql("signature", 10, "signature_alert"))
register("signature_top6", on_decisions(DB.signature_top), top_sql("signature", 6, "signature_alert", "replace(signature, 'LOCAL ', '')"))
register("protocol_mix", on_decisions(DB.protocol_mix), top_sql("proto", 8))
_LADDER = " ".join(f"WHEN span <= {s * DB.TARGET_BUCKETS} THEN {s}" for s in DB.BUCKET_LADDER[:-1])
register("flows_over_time", on_decisions(lambda d: text_time(DB.flows_over_time(d), "bucket")), WITH.rstrip() + f""",
w AS (SELECT CASE {_LADDER} ELSE {DB.BUCKET_LADDER[-1]} END AS w FROM
  (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span FROM events) s)
SELECT {SQL_TS.format('to_timestamp_v')} AS bucket, verdict, count(*) AS n FROM (
  SELECT verdict, make_timestamp(CAST(epoch_us(ts) // 1000000 // w * w AS BIGINT) * 1000000) AS to_timestamp_v
  FROM decisions_v, w) b GROUP BY 1, 2""")
_BY_VERDICT = ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in VERDICTS)
_RATE = f"""rates AS (SELECT time_bucket(INTERVAL '5 seconds', ts) AS b, {_BY_VERDICT}, count(*) AS total FROM decisions_v
  GROUP BY 1)"""
register("flow_rate_5s", on_decisions(lambda d: text_time(DB.flow_rate(d), "bucket")), WITH.rstrip() + f""", {_RATE}
SELECT {SQL_TS.format('b')} AS bucket, {", ".join(VERDICTS)}, total FROM rates""")
register("cumulative_attacks", on_decisions(lambda d: text_time(DB.cumulative_attacks(d), "bucket")), WITH.rstrip() + f""", {_RATE}
SELECT {SQL_TS.format('b')} AS bucket, total - benign AS attacks,
  CAST(sum(total - benign) OVER (ORDER BY b ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM rates""")
register("proba_histogram", on_decisions(lambda d: DB.proba_histogram(d).withColumn("bin_start", F.round("bin_start", 4))), WITH + """
SELECT bin, round(bin * 0.05, 4) AS bin_start, n FROM (
  SELECT CAST(floor(model_proba / CAST(0.05 AS DOUBLE)) AS BIGINT) AS bin, count(*) AS n FROM decisions_v GROUP BY 1) t""")
register("recent_alerts", on_decisions(lambda d: text_time(DB.recent_alerts(d))), WITH + f"""
SELECT {SQL_TS.format('t.ts')} AS ts, src_ip, dst_ip, dst_port, model_proba, signature, verdict FROM
  (SELECT * FROM decisions_v WHERE fused_decision ORDER BY ts DESC, flow_id DESC LIMIT 300) t""")
register("recent_flows", on_decisions(lambda d: text_time(DB.recent_flows(d)).select("flow_id", "ts", "src_ip", "model_proba", "verdict")), WITH + f"""
SELECT flow_id, {SQL_TS.format('t.ts')} AS ts, src_ip, model_proba, verdict FROM
  (SELECT * FROM decisions_v ORDER BY ts DESC, flow_id DESC LIMIT 500) t""")
register("recent_signature_log", on_decisions(lambda d: text_time(DB.recent_signature_log(d)).select("flow_id", "ts", "signature")), WITH + f"""
SELECT flow_id, {SQL_TS.format('t.ts')} AS ts, signature FROM
  (SELECT * FROM decisions_v WHERE signature_alert ORDER BY ts DESC, flow_id DESC LIMIT 200) t""")
register("recent_probabilities", on_decisions(lambda d: text_time(DB.recent_probabilities(d))), WITH + f"""
SELECT {SQL_TS.format('t.ts')} AS ts, model_proba, verdict FROM
  (SELECT * FROM decisions_v ORDER BY ts DESC, flow_id DESC LIMIT 400) t""")
register("attacker_share", on_decisions(DB.attacker_share), WITH + """
SELECT src_ip, n, round(100.0 * n / (SELECT count(*) FROM decisions_v WHERE fused_decision), 1) AS share_pct
FROM (SELECT src_ip, count(*) AS n FROM decisions_v WHERE fused_decision GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 10) t""")
_TOTALS = f"""SELECT count(*) AS flows, count(*) FILTER (fused_decision) AS attacks, {_BY_VERDICT},
  CAST(sum(bytes_total) AS BIGINT) AS bytes, CAST(sum(pkts_total) AS BIGINT) AS packets,
  CAST(sum(CASE WHEN fused_decision THEN bytes_total ELSE 0 END) AS BIGINT) AS attack_bytes FROM decisions_v"""
register("session_totals", on_decisions(DB.session_totals), WITH + _TOTALS)
register("agreement_pct", on_decisions(DB.agreement_pct), WITH + """
SELECT round(100.0 * count(*) FILTER (verdict IN ('attack_both', 'benign')) / count(*), 1) AS agreement_pct,
  round(100.0 * count(*) FILTER (fused_decision) / count(*), 1) AS attack_pct FROM decisions_v""")
register("agreement_matrix", on_decisions(DB.agreement_matrix), WITH + """
SELECT CAST(signature_alert AS INTEGER) AS signature_attack, CAST(model_decision AS INTEGER) AS model_attack, count(*) AS n,
  round(100.0 * count(*) / (SELECT count(*) FROM decisions_v), 1) AS share_pct FROM decisions_v GROUP BY 1, 2""")
_NAMES = " ".join(f"WHEN '{s}' THEN '{a}'" for s, a in RU.ATTACK_NAME_BY_SIGNATURE.items())
register("attack_type_distribution", on_decisions(lambda d: DB.attack_type_distribution(d).withColumn(
    "ratio_to_max", F.round("ratio_to_max", 6))), WITH + f"""
SELECT attack_name, n, round(n / CAST(max(n) OVER () AS DOUBLE), 6) AS ratio_to_max FROM (
  SELECT CASE signature {_NAMES} END AS attack_name, count(*) AS n FROM decisions_v WHERE signature_alert GROUP BY 1) t""")
GRID = [0.1, 0.25, 0.5, 0.75, 0.9]
register("threshold_whatif", on_decisions(lambda d: DB.threshold_whatif(d, GRID)), WITH + f"""
SELECT t AS threshold, count(*) FILTER (NOT signature_alert AND model_proba < t) AS benign,
  count(*) FILTER (signature_alert AND model_proba < t) AS attack_suricata_only,
  count(*) FILTER (NOT signature_alert AND model_proba >= t) AS attack_ml_only,
  count(*) FILTER (signature_alert AND model_proba >= t) AS attack_both
FROM decisions_v, (SELECT CAST(unnest([{", ".join(map(str, GRID))}]) AS DOUBLE) AS t) g GROUP BY t""")
register("time_range_filter", on_decisions(lambda d: text_time(DB.time_range(d, 30)).select("flow_id", "ts", "verdict")), WITH + f"""
SELECT flow_id, {SQL_TS.format('ts')} AS ts, verdict FROM decisions_v
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE""")

# ---- rules ------------------------------------------------------------------------
TW = "WITH " + S.TRAFFIC_SQL + " "
_PLAIN_WHERE = {
    "icmp_echo": "proto = 'ICMP' AND icmp_type = 8",
    "http_login_post": "http_method = 'POST' AND lower(http_uri) LIKE '%login%'",
    "sqli_union": "lower(http_uri) LIKE '%union%select%'",
    "sqli_quote_or": "regexp_matches(lower(http_uri), '%27.*or')",
}
_BURST_WHERE = {
    "ssh_burst": "proto = 'TCP' AND dst_port = 22",
    "ftp_burst": "proto = 'TCP' AND dst_port = 21 AND lower(ftp_command) LIKE '%user%'",
    "syn_scan": "proto = 'TCP' AND tcp_syn AND NOT tcp_ack",
}


def rule_sql(name):
    rule = RU.RULES[name]
    ts = SQL_TS.format("make_timestamp(CAST(us AS BIGINT))")
    if rule.count is None:
        return (f"SELECT {ts} AS ts, src_ip, CAST(1 AS BIGINT) AS hits, {rule.sid} AS sid, '{rule.signature}' AS signature "
                f"FROM traffic_v WHERE {_PLAIN_WHERE[name]}")
    return (f"SELECT {ts} AS ts, src_ip, hits, {rule.sid} AS sid, '{rule.signature}' AS signature FROM ("
            f"SELECT us // {rule.seconds * 1000000} * {rule.seconds * 1000000} AS us, src_ip, count(*) AS hits "
            f"FROM traffic_v WHERE {_BURST_WHERE[name]} GROUP BY 1, 2 HAVING count(*) >= {rule.count}) t_{name}")


def run_rules(*names):
    return lambda spark, sf: text_time(RU.apply_rules(S.traffic(spark, sf), list(names)))


for _name in RU.RULES:
    register(f"rule_{_name}", run_rules(_name), TW + rule_sql(_name))
register("rule_apply", run_rules(*RU.RULES), TW + " UNION ALL ".join(rule_sql(n) for n in RU.RULES))
