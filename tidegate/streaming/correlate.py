"""Alerts meeting flows on a stream, in two forms.

`take_alerts` is the exact form, on micro-batches: an alert waits for the next flow of its id, the newest alert
wins, one flow uses it up. `interval_join` is the form with watermarks: every alert in a time range
around the flow matches, and unmatched flows appear when the watermark has passed, which heartbeats move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from tidegate.functions.decision import has_signature

DEFAULT_TTL_SECONDS = 600


def interval_join(flows: DataFrame, alerts: DataFrame, lookback: str = "10 minutes", ahead: str = "0 seconds") -> DataFrame:
    """Left outer join of two watermarked streams on flow_id and time.

    A flow with several alerts in range appears once per alert; `last_alert_per_flow` reduces them.
    """
    right = alerts.select(F.col("flow_id").alias("alert_flow_id"), F.col("signature").alias("_sig"), "alert_ts")
    condition = (
        (F.col("flow_id") == F.col("alert_flow_id"))
        & (F.col("alert_ts") >= F.col("ts") - F.expr(f"INTERVAL {lookback}"))
        & (F.col("alert_ts") <= F.col("ts") + F.expr(f"INTERVAL {ahead}"))
    )
    joined = flows.join(right, condition, "left").withColumn("signature", F.coalesce("_sig", F.lit("")))
    return joined.drop("alert_flow_id", "_sig").withColumn("signature_alert", has_signature(F.col("signature")))


def last_alert_per_flow(joined: DataFrame) -> DataFrame:
    """Batch reduction of an interval join: one row per flow record, newest alert kept."""
    identity = [c for c in joined.columns if c not in ("signature", "signature_alert", "alert_ts")]
    newest = joined.groupBy(*identity).agg(F.max_by("signature", "alert_ts").alias("_s"), F.max("signature").alias("_any"))
    merged = newest.withColumn("signature", F.coalesce("_s", "_any", F.lit(""))).drop("_s", "_any")
    return merged.withColumn("signature_alert", has_signature(F.col("signature")))


WAITING = T.StructType([
    T.StructField("flow_id", T.StringType()), T.StructField("signature", T.StringType()),
    T.StructField("arrived", T.TimestampType())])


def take_alerts(
    flows: DataFrame, alerts: DataFrame, waiting: DataFrame, ttl_seconds: int = DEFAULT_TTL_SECONDS
) -> DataFrame:
    """The rows of a micro-batch, each flow with the alert it uses up.

    `flows` and `alerts` have flow_id, seq (their place in the log) and arrived; `waiting` has the alerts left by
    earlier batches. In log order an alert takes the place of one of the same flow that still waits, and a flow uses
    the waiting one up, if it arrived at most `ttl_seconds` before. So a flow's alert is the row before it, and no
    group is ever collected. Returns the flows' columns, signature, and `_flow`: false marks alerts that now wait.
    Flows without an id use no alert, alerts without one are left out; both stay out of the sort.
    """
    carried = [c for c in flows.columns if c not in ("flow_id", "seq", "arrived")]
    kinds = {f.name: f.dataType for f in flows.schema.fields}
    empty = [F.lit(None).cast(kinds[c]).alias(c) for c in carried]
    place = F.struct(F.lit(1).alias("now"), F.col("seq"))
    before = F.struct(F.lit(0).alias("now"), F.lit(None).cast(kinds["seq"]).alias("seq"))
    none = F.lit(None).cast("string").alias("signature")
    rows = flows.select("flow_id", place.alias("_place"), "arrived", F.lit(True).alias("_flow"), none, *carried)
    known = alerts.filter(F.col("flow_id").isNotNull()).select(
        "flow_id", place.alias("_place"), "arrived", F.lit(False).alias("_flow"), "signature", *empty)
    held = waiting.select("flow_id", before.alias("_place"), "arrived", F.lit(False).alias("_flow"), "signature", *empty)
    steps = rows.filter(F.col("flow_id").isNotNull()).unionByName(known).unionByName(held)
    order = Window.partitionBy("flow_id").orderBy("_place", "_flow")
    row = F.struct("_flow", "signature", "arrived")
    steps = steps.withColumns({"_before": F.lag(row).over(order), "_after": F.lead("_flow").over(order)})
    fresh = F.col("arrived") <= F.col("_before.arrived") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    used = F.when(~F.col("_before._flow") & fresh, F.col("_before.signature"))
    taken = steps.filter(F.col("_flow") | F.col("_after").isNull()).withColumn(
        "signature", F.when(F.col("_flow"), F.coalesce(used, F.lit(""))).otherwise(F.col("signature")))
    anonymous = rows.filter(F.col("flow_id").isNull()).withColumn("signature", F.lit(""))
    columns = ["flow_id", "arrived", "_flow", "signature", *carried]
    return taken.select(*columns).unionByName(anonymous.select(*columns))


def still_waiting(taken: DataFrame, now, ttl_seconds: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Of a batch's rows, the alerts that the next batches may use; `now` is the time of this batch."""
    alive = F.col("arrived") + F.make_dt_interval(secs=F.lit(ttl_seconds)) >= F.lit(now)
    return taken.filter(~F.col("_flow") & alive).select("flow_id", "signature", "arrived")
