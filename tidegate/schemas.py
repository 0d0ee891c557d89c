"""Table layouts and value lists shared by the whole library."""

from __future__ import annotations

from pyspark.sql import types as T

# The names of the 77 flow features, in table order.
FLOW_FEATURES = [
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Length", "Bwd Header Length",
    "Fwd Packets/s", "Bwd Packets/s",
    "Min Packet Length", "Max Packet Length",
    "Packet Length Mean", "Packet Length Std", "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count",
    "ACK Flag Count", "URG Flag Count", "CWE Flag Count", "ECE Flag Count",
    "Down/Up Ratio", "Average Packet Size",
    "Avg Fwd Segment Size", "Avg Bwd Segment Size", "Fwd Header Length.1",
    "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "Init_Win_bytes_forward", "Init_Win_bytes_backward",
    "act_data_pkt_fwd", "min_seg_size_forward",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]

# Columns of a raw flow table that identify a flow instead of describing it.
IDENTIFIER_COLUMNS = [
    "Flow ID", "Source IP", "Source Port", "Destination IP", "Destination Port",
    "Timestamp", "SimillarHTTP", "Inbound", "Unnamed: 0",
]

LABEL = "Label"
CATEGORY = "Category"
BENIGN = "BENIGN"

_COUNTERS = [
    ("pkts_toserver", T.DoubleType()), ("pkts_toclient", T.DoubleType()),
    ("bytes_toserver", T.DoubleType()), ("bytes_toclient", T.DoubleType()),
    ("start", T.StringType()), ("end", T.StringType()), ("age", T.DoubleType()),
]


def _struct(fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# One event-log line. flow_id stays text so that 19-digit ids survive.
EVENT = _struct(
    [
        ("timestamp", T.StringType()), ("event_type", T.StringType()), ("flow_id", T.StringType()),
        ("src_ip", T.StringType()), ("dest_ip", T.StringType()), ("dest_port", T.StringType()),
        ("proto", T.StringType()), ("icmp_type", T.IntegerType()),
        ("flow", _struct(_COUNTERS)),
    ]
    + _COUNTERS
    + [
        ("tcp", _struct([(flag, T.StringType()) for flag in ("syn", "ack", "fin", "rst", "psh", "urg")])),
        ("alert", _struct([("signature", T.StringType())])),
        ("http", _struct([("http_method", T.StringType()), ("url", T.StringType())])),
        ("ftp", _struct([("command", T.StringType())])),
        ("_corrupt_record", T.StringType()),
    ]
)

# Column names and order of the two decision layouts.
DECISION_BATCH = _struct([
    ("timestamp", T.StringType()), ("src_ip", T.StringType()), ("dst_ip", T.StringType()),
    ("dst_port", T.StringType()), ("proto", T.StringType()), ("bytes_total", T.DoubleType()),
    ("suricata_alert", T.IntegerType()), ("suricata_signature", T.StringType()),
    ("ml_proba", T.DoubleType()), ("ml_decision", T.IntegerType()),
    ("fused_decision", T.IntegerType()), ("fusion_reason", T.StringType()),
])

DECISION_LIVE = _struct([
    ("@timestamp", T.StringType()), ("flow_id", T.StringType()), ("src_ip", T.StringType()),
    ("dst_ip", T.StringType()), ("dst_port", T.IntegerType()), ("proto", T.StringType()),
    ("bytes_total", T.LongType()), ("pkts_total", T.LongType()), ("duration_ms", T.DoubleType()),
    ("suricata_alert", T.BooleanType()), ("suricata_signature", T.StringType()),
    ("ml_proba", T.DoubleType()), ("ml_decision", T.BooleanType()),
    ("fused_decision", T.BooleanType()), ("fusion_reason", T.StringType()), ("verdict", T.StringType()),
])

GROUND_TRUTH = _struct([("src_ip", T.StringType()), ("is_attack", T.IntegerType())])
