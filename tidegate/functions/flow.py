"""Flow features as column expressions over parsed event-log records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidegate.functions.numbers import ratio
from tidegate.schemas import FLOW_FEATURES

TCP_FLAGS = {
    "SYN Flag Count": "syn", "ACK Flag Count": "ack", "FIN Flag Count": "fin",
    "RST Flag Count": "rst", "PSH Flag Count": "psh", "URG Flag Count": "urg",
}


def flow_field(name: str) -> Column:
    """A counter from the nested flow object, or from the top level when there is none."""
    return F.when(F.col("flow").isNotNull(), F.col(f"flow.{name}")).otherwise(F.col(name))


def counter(name: str) -> Column:
    return F.coalesce(flow_field(name), F.lit(0.0))


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text with any zone form to a timestamp; null when it does not parse."""
    return F.try_to_timestamp(text)


def duration_us(start: Column, end: Column) -> Column:
    """Microseconds between two ISO texts, never negative, 0 when either is unusable."""
    span = F.unix_micros(iso_timestamp(end)) - F.unix_micros(iso_timestamp(start))
    return F.greatest(F.coalesce(span, F.lit(0)), F.lit(0)).cast("double")


def flag_value(text: Column) -> Column:
    """A TCP flag given as true/false or as a number."""
    lowered = F.lower(text)
    return F.coalesce(
        F.when(lowered == "true", F.lit(1.0))
        .when(lowered == "false", F.lit(0.0))
        .otherwise(text.try_cast("double")),
        F.lit(0.0),
    )


def base_columns() -> dict[str, Column]:
    """Shared inputs of the feature expressions, computed once per record."""
    return {
        "_pkts_to": counter("pkts_toserver"),
        "_pkts_from": counter("pkts_toclient"),
        "_bytes_to": counter("bytes_toserver"),
        "_bytes_from": counter("bytes_toclient"),
        "_duration": duration_us(flow_field("start"), flow_field("end")),
    }


def feature_columns() -> list[Column]:
    """All 77 features in table order over `base_columns`; features the log lacks are 0."""
    pkts_to, pkts_from = F.col("_pkts_to"), F.col("_pkts_from")
    bytes_to, bytes_from = F.col("_bytes_to"), F.col("_bytes_from")
    duration = F.col("_duration")
    pkts, octets = pkts_to + pkts_from, bytes_to + bytes_from
    seconds = duration / F.lit(1_000_000.0)
    mean_size = ratio(octets, pkts)
    known = {
        "Flow Duration": duration,
        "Total Fwd Packets": pkts_to,
        "Subflow Fwd Packets": pkts_to,
        "Total Backward Packets": pkts_from,
        "Subflow Bwd Packets": pkts_from,
        "Total Length of Fwd Packets": bytes_to,
        "Subflow Fwd Bytes": bytes_to,
        "Total Length of Bwd Packets": bytes_from,
        "Subflow Bwd Bytes": bytes_from,
        "Flow Bytes/s": ratio(octets, seconds),
        "Flow Packets/s": ratio(pkts, seconds),
        "Fwd Packets/s": ratio(pkts_to, seconds),
        "Bwd Packets/s": ratio(pkts_from, seconds),
        "Average Packet Size": mean_size,
        "Packet Length Mean": mean_size,
        "Avg Fwd Segment Size": ratio(bytes_to, pkts_to),
        "Avg Bwd Segment Size": ratio(bytes_from, pkts_from),
        "Down/Up Ratio": ratio(pkts_from, pkts_to),
    }
    for feature, flag in TCP_FLAGS.items():
        known[feature] = flag_value(F.col(f"tcp.{flag}"))
    return [known.get(name, F.lit(0.0)).alias(name) for name in FLOW_FEATURES]
