"""Event log as a stream: a landing folder into which finished files are moved, or growing files that are followed.

The stream has the records' columns, `place` (order within a micro-batch: file, then byte or split) and `arrived` (time
of the micro-batch, the same when it is repeated).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegate.operators.decisions import flow_totals
from tidegate.sources.event_log import alert_events, parse_lines, prefilter_kinds, well_formed
from tidegate.sources.log_follower import follow

DEFAULT_DELAY = "1 minute"
#: Records of this kind carry a time only: they move the watermark when nothing else comes.
HEARTBEAT = "heartbeat"


def _parsed(lines: DataFrame, place: Column, arrived: Column | None) -> DataFrame:
    stamped = lines.select("value", place.alias("place"), (F.current_timestamp() if arrived is None else arrived).alias("arrived"))
    return parse_lines(prefilter_kinds(stamped, ("flow", "alert", HEARTBEAT)), keep=["place", "arrived"])


def log_stream(
    spark: SparkSession, landing: str, from_end: datetime | None = None, files_per_trigger: int | None = None,
    arrived: Column | None = None,
) -> DataFrame:
    """Parsed records of all files in the folder and of those that arrive later.

    `from_end` skips files last changed before that moment, which is how a follower starts at the
    end of a log. `files_per_trigger` bounds a micro-batch. `arrived` replaces the time of the micro-batch.
    """
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.load(landing)
    if from_end is not None:
        lines = lines.filter(F.col("_metadata.file_modification_time") > F.lit(from_end))
    place = F.struct(F.lit(0).alias("part"), F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("byte"))
    return _parsed(lines, place, arrived)


def followed_log(spark: SparkSession, path: str, from_end: bool = False, arrived: Column | None = None) -> DataFrame:
    """Parsed records of growing files (a path or a glob), through truncation and rotation."""
    place = F.struct("part", F.col("source").alias("file"), F.col("position").alias("byte"))
    return _parsed(follow(spark, path, from_end), place, arrived)


def heartbeat_line(spark: SparkSession, at: str) -> DataFrame:
    """A log line saying that the log has come to the time `at` (ISO text)."""
    line = F.to_json(F.struct(F.lit(HEARTBEAT).alias("event_type"), F.lit(at).alias("timestamp")))
    return spark.range(1).select(line.alias("value"))


def behind_watermark(rows: DataFrame, time: str, delay: str, kind: str, wanted: str) -> DataFrame:
    """Rows of the `wanted` kind, after all rows have moved the watermark.

    The test reads the time as well: a test of the kind alone would be moved before the watermark.
    """
    timed = rows.withWatermark(time, delay)
    both = F.concat_ws("|", F.coalesce(F.col(kind), F.lit("")), F.col(time).cast("string"))
    return timed.filter(both.startswith(f"{wanted}|")).drop(kind)


def _kinds(events: DataFrame, kind: str) -> DataFrame:
    return well_formed(events).filter(F.col("event_type").isin(kind, HEARTBEAT))


def flow_stream(events: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Flow records with totals and an event-time watermark on ts."""
    return behind_watermark(flow_totals(_kinds(events, "flow"), ["event_type"]), "ts", delay, "event_type", "flow")


def alert_stream(events: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """flow_id, signature, alert_ts with a watermark; alerts without a flow or a time are left out."""
    # heartbeats get an id: joins drop rows without one before they could move the watermark
    flow_id = F.when(F.col("event_type") == HEARTBEAT, F.lit("")).otherwise(F.col("flow_id"))
    rows = _kinds(events, "alert").select(
        "event_type", flow_id.alias("flow_id"), F.coalesce("alert.signature", F.lit("")).alias("signature"),
        F.try_to_timestamp("timestamp").alias("alert_ts"))
    usable = rows.filter(F.col("flow_id").isNotNull() & F.col("alert_ts").isNotNull())
    return behind_watermark(usable, "alert_ts", delay, "event_type", "alert")
