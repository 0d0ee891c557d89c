"""Streaming queries: the log derived from the given tables is landed as files and streamed.

Their results equal batch results, so the SQL of the batch form checks them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog import surrogates as S
from tidegate.catalog.decisions import _BY_VERDICT, _TOTALS, SQL_TS, text_time
from tidegate.catalog.eventlog import _proxy_probability
from tidegate.catalog.registry import register
from tidegate.functions.decision import VERDICTS
from tidegate.session import scratch_path, stage
from tidegate.streaming import correlate, live, source

WITH = "WITH " + S.PARSED_SQL + " "
DELAY = "1 minute"
PHASES = 3


def _phase():
    """Of a log line: the phase in which it lands, by its flow."""
    return F.pmod(F.get_json_object("value", "$.flow_id").cast("long"), F.lit(PHASES))


def landed(spark, sf, heartbeat=None):
    """The log as files in a landing folder, and with `heartbeat` a second run's file that moves the time on."""
    path = scratch_path(spark, "landing")
    S.log_lines(spark, sf).write.text(path)
    if heartbeat:
        source.heartbeat_line(spark, heartbeat).write.mode("append").text(path)
    return source.log_stream(spark, path)


def finished(stream, mode="append", out=None, state=None):
    spark = stream.sparkSession
    out = out or scratch_path(spark, "stream-out")
    live.run_available(stream, out, state or scratch_path(spark, "stream-state"), mode)
    return spark.read.parquet(out)


def _scan(spark, sf):
    """The log follows as growing files: what lands while the job is stopped is read by its next run."""
    path, out, state = (scratch_path(spark, n) for n in ("growing", "stream-out", "stream-state"))
    lines = stage(S.log_lines(spark, sf).withColumn("phase", _phase()), "lines")
    for phase in range(PHASES):
        lines.filter(F.col("phase") == phase).select("value").write.mode("append").text(path)
        events = source.followed_log(spark, path.removeprefix("file:") + "/part-*")
        finished(events.select("event_type", "flow_id"), out=out, state=state)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


register("scan_eve_stream", _scan, WITH + """
SELECT 'flow' AS event_type, count(*) AS n FROM parsed_v UNION ALL
SELECT 'alert', count(*) FILTER (signature <> '') FROM parsed_v""")


def live_run(spark, sf, line_phase=_phase, minutes=(0, 0, 0), scorer=_proxy_probability):
    """The live job over a log that lands in phases, a restart after each: later phases are older by event time as often
    as not. `minutes` are the arrival times of the phases. Returns the folder of results."""
    landing, out, state = (scratch_path(spark, n) for n in ("landing", "decisions", "state"))
    lines = stage(S.log_lines(spark, sf).withColumn("phase", line_phase()), "lines")
    for phase, minute in enumerate(minutes):
        lines.filter(F.col("phase") == phase).select("value").write.mode("append").text(landing)
        arrived = F.lit(f"2024-01-01 00:{minute:02d}:00").cast("timestamp")
        events = source.log_stream(spark, landing, arrived=arrived)
        live.finish(live.stream_decisions(spark, events, scorer, out, state, delay=DELAY, once=True))
    return out


def _consume(spark, sf):
    """Alerts arrive first; flows with even ids 5 minutes later, the others after their alerts' time is up."""
    def phase():
        flow = F.get_json_object("value", "$.event_type") == "flow"
        return F.when(flow, F.pmod(F.get_json_object("value", "$.flow_id").cast("long"), F.lit(2)) + 1).otherwise(0)

    out = live_run(spark, sf, phase, (0, 5, 15))
    return live.read_documents(spark, out).select(
        "flow_id", "src_ip", F.col("bytes_total").cast("double").alias("bytes_total"),
        F.coalesce("suricata_signature", F.lit("")).alias("signature"), F.col("suricata_alert").alias("signature_alert"))


register("alert_ttl_state", _consume, WITH.rstrip() + """,
u AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN signature ELSE '' END AS used FROM parsed_v)
SELECT flow_id, src_ip, CAST(bytes_to + bytes_from AS DOUBLE) AS bytes_total, used AS signature, used <> '' AS signature_alert FROM u""")


def _interval(spark, sf):
    """A heartbeat far ahead closes the join, so flows without an alert come out too."""
    events = landed(spark, sf, heartbeat="2100-01-01T00:00:00.000000Z")
    joined = correlate.interval_join(source.flow_stream(events, DELAY), source.alert_stream(events, DELAY))
    columns = ["flow_id", "ts", "signature", "signature_alert", "alert_ts"]
    rows = correlate.last_alert_per_flow(finished(joined.select(columns)))
    return rows.select("flow_id", "signature", "signature_alert")


register("stream_alert_flow_join", _interval, WITH + "SELECT flow_id, signature, signature <> '' AS signature_alert FROM parsed_v")

DECIDED = """,
s AS (SELECT *, 1.0 / (1.0 + exp(-(CASE WHEN pkts_to > 0 THEN pkts_from / CAST(pkts_to AS DOUBLE) ELSE 0 END - 1.0))) AS p FROM parsed_v),
d AS (SELECT *, signature <> '' OR p >= 0.5 AS fused,
  CASE WHEN signature <> '' AND p >= 0.5 THEN 'suricata+ml' WHEN signature <> '' THEN 'suricata' WHEN p >= 0.5 THEN 'ml' ELSE 'none' END AS reason,
  CASE WHEN signature <> '' AND p >= 0.5 THEN 'attack_both' WHEN signature <> '' THEN 'attack_suricata_only'
       WHEN p >= 0.5 THEN 'attack_ml_only' ELSE 'benign' END AS verdict FROM s)
"""


def _decisions(spark, sf):
    return live.read_documents(spark, live_run(spark, sf)).select(
        "flow_id", "suricata_signature", "ml_proba", "fused_decision", "fusion_reason", "verdict")


register("stream_decisions", _decisions, WITH.rstrip() + DECIDED + """
SELECT flow_id, signature AS suricata_signature, round(p, 6) AS ml_proba, fused AS fused_decision, reason AS fusion_reason, verdict FROM d""")


def _late(spark, sf):
    """Each run's flows, those older than the newest one of the runs before by the delay, and all decided ones."""
    out = live_run(spark, sf)
    decided = live.read_documents(spark, out).groupBy(
        F.pmod(F.col("flow_id").cast("long"), F.lit(PHASES)).alias("batch")).agg(F.count(F.lit(1)).alias("decided"))
    return live.progress_summary(spark, out).select("batch", "flows", "alerted", "late").join(decided, "batch")


register("late_data", _late, WITH.rstrip() + """,
seen AS (SELECT event_id % 3 AS batch, max(ts) AS newest FROM parsed_v GROUP BY 1),
marks AS (SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM seen)
SELECT batch, count(*) AS flows, count(*) FILTER (signature <> '') AS alerted, count(*) FILTER (ts < mark - INTERVAL 1 MINUTE) AS late,
  count(*) AS decided FROM parsed_v JOIN marks ON batch = event_id % 3 GROUP BY batch""")


def _replayed(spark, sf):
    """Decisions of a table through the sink in more batches than one merge takes, each sent twice."""
    out, state, files = (scratch_path(spark, n) for n in ("sink", "state", "decision-files"))
    rows = S.decisions(spark, sf)
    rows.repartition(12, "flow_id").write.parquet(files)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(files)
    sent = live.DecisionWriter(spark, out, state, DELAY)

    def twice(batch, number):
        sent(batch, number)
        sent(batch, number)

    live.finish(stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(twice).start())
    return out


register("sink_decisions_stream", lambda spark, sf: live.read_documents(spark, _replayed(spark, sf)).withColumnRenamed(
    "@timestamp", "stamp"), "WITH " + S.DECISIONS_SQL + """
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS stamp, flow_id, src_ip, dst_ip, dst_port, proto, CAST(bytes_total AS BIGINT) AS bytes_total,
  CAST(pkts_total AS BIGINT) AS pkts_total, CAST(floor(duration_us / 1e6) AS DOUBLE) AS duration_ms, signature_alert AS suricata_alert,
  signature AS suricata_signature, round(model_proba, 6) AS ml_proba, model_decision AS ml_decision, fused_decision, fusion_reason, verdict
FROM decisions_v""")
register("sink_csv_mirror", lambda spark, sf: live.read_mirror(spark, _replayed(spark, sf)).withColumn(
    "suricata_signature", F.coalesce("suricata_signature", F.lit(""))), "WITH " + S.DECISIONS_SQL + """
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS timestamp, src_ip, dst_ip, CAST(dst_port AS VARCHAR) AS dst_port, proto,
  CAST(bytes_total AS DOUBLE) AS bytes_total, CAST(signature_alert AS INTEGER) AS suricata_alert, signature AS suricata_signature,
  round(model_proba, 6) AS ml_proba, CAST(model_decision AS INTEGER) AS ml_decision, CAST(fused_decision AS INTEGER) AS fused_decision,
  fusion_reason FROM decisions_v""")


def decision_rows(spark, sf, heartbeat=None):
    """The decision table as a stream of files, and a heartbeat row at the end if a time is given."""
    path = scratch_path(spark, "decision-files")
    rows = S.decisions(spark, sf)
    rows.write.parquet(path)
    schema = spark.read.parquet(path).schema
    if heartbeat:
        at = F.lit(heartbeat).cast("timestamp")
        last = [(at if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
        spark.range(1).select(*last).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


register("stream_session_totals", lambda spark, sf: finished(live.stream_session_totals(decision_rows(spark, sf)), "complete"),
         "WITH " + S.DECISIONS_SQL + " " + _TOTALS)
register("stream_flow_rate", lambda spark, sf: text_time(finished(live.stream_flow_rate(
    decision_rows(spark, sf, "2100-01-01 00:00:00"), DELAY)), "bucket"), "WITH " + S.DECISIONS_SQL + f""",
r AS (SELECT time_bucket(INTERVAL '5 seconds', ts) AS b, {_BY_VERDICT}, count(*) AS total FROM decisions_v GROUP BY 1)
SELECT {SQL_TS.format('b')} AS bucket, {", ".join(VERDICTS)}, total FROM r""")


def _progress(spark, sf):
    """Counters of all batches, from the table that the sink commits."""
    return live.progress_summary(spark, _replayed(spark, sf)).agg(*[F.sum(c).alias(c) for c in ("flows", "fused", "agreement")])


register("progress_summary", _progress, "WITH " + S.DECISIONS_SQL + """
SELECT count(*) AS flows, count(*) FILTER (fused_decision) AS fused, count(*) FILTER (signature_alert = model_decision) AS agreement FROM decisions_v""")
