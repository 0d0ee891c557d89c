"""Event-log lines (one JSON object per line) as typed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.schemas import EVENT

_KINDS = ("flow", "alert")


def parse_lines(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Parse a `value` column; blank lines go, malformed lines keep their text in _corrupt_record."""
    present = lines.filter(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_json("value", EVENT, options)
    return present.select(*(keep or []), parsed.alias("r")).select(*(keep or []), "r.*")


def well_formed(events: DataFrame) -> DataFrame:
    return events.filter(F.col("_corrupt_record").isNull() & F.col("event_type").isNotNull())


def malformed(events: DataFrame) -> DataFrame:
    """The lines that were skipped, for counting or keeping aside."""
    return events.filter(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Batch scan. `seq` is the position in the log: file by name, split of the file, line of the split.

    Numbers of rows rise within a task, which reads the lines of a split in order; they say nothing about the order
    of files or splits, so these come first.
    """
    seq = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", seq.alias("seq"))
    return parse_lines(lines, keep=["seq"])


def flow_events(events: DataFrame) -> DataFrame:
    return well_formed(events).filter(F.col("event_type") == "flow")


def alert_events(events: DataFrame) -> DataFrame:
    """Alerts reduced to flow_id, signature, time and position (the time again where positions are not known)."""
    alerts = well_formed(events).filter(F.col("event_type") == "alert")
    time = F.try_to_timestamp("timestamp")
    order = F.col("seq") if "seq" in events.columns else time
    return alerts.select(
        "flow_id", F.coalesce("alert.signature", F.lit("")).alias("signature"), time.alias("ts"), order.alias("seq"))


def prefilter_kinds(lines: DataFrame, kinds: tuple[str, ...] = _KINDS) -> DataFrame:
    """Cheap text test that drops lines of other event types before they are parsed."""
    test = F.lit(False)
    for kind in kinds:
        test = test | F.col("value").contains(f'"{kind}"')
    return lines.filter(test)
