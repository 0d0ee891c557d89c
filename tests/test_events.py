import json

import pytest
from pyspark.sql import functions as F

from tidegate.functions.numbers import finite_or_zero
from tidegate.operators import decisions as OD
from tidegate.operators import dashboards as DB
from tidegate.operators import report as RP
from tidegate.operators import rules as RU
from tidegate.operators.cleaning import quoted
from tidegate.plans.bridge import decide, decision_batch_job
from tidegate.schemas import DECISION_BATCH, DECISION_LIVE, FLOW_FEATURES
from tidegate.sources import event_log as L
from tidegate.sources.tables import read_decisions_csv, read_ground_truth

BIG_ID = 1234567890123456789


def flow(**changes):
    record = {
        "timestamp": "2024-01-01T00:00:05.000000+0000", "event_type": "flow", "flow_id": BIG_ID, "src_ip": "172.16.0.5",
        "dest_ip": "192.168.10.51", "dest_port": 22, "proto": "TCP",
        "flow": {"pkts_toserver": 5, "pkts_toclient": 4, "bytes_toserver": 400, "bytes_toclient": 300,
                 "start": "2024-01-01T00:00:00.000000+0000", "end": "2024-01-01T00:00:04.500000Z", "age": 4},
        "tcp": {"syn": True, "ack": 1, "fin": False},
    }
    record.update(changes)
    return {k: v for k, v in record.items() if v is not None}


def alert(flow_id, signature, at="2024-01-01T00:00:01.000000+0000"):
    record = {"timestamp": at, "event_type": "alert", "src_ip": "172.16.0.5", "alert": {}}
    if flow_id is not None:
        record["flow_id"] = flow_id
    if signature is not None:
        record["alert"]["signature"] = signature
    return record


def parse(spark, records):
    lines = [r if isinstance(r, str) else json.dumps(r) for r in records]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "seq long, value string")
    return L.parse_lines(table, keep=["seq"])


def test_lines(spark):
    events = parse(spark, [flow(), "", "   ", "{broken", alert(1, "A"), {"event_type": "http"}])
    assert L.malformed(events).count() == 1
    assert L.flow_events(events).count() == 1 and L.alert_events(events).count() == 1
    assert L.flow_events(events).first().flow_id == str(BIG_ID)


def features(spark, record):
    row = OD.flow_to_features(L.flow_events(parse(spark, [record]))).first()
    return {name: row[name] for name in FLOW_FEATURES}


def test_features_of_a_flow(spark):
    f = features(spark, flow())
    assert f["Flow Duration"] == 4_500_000.0
    assert f["Flow Bytes/s"] == pytest.approx(700 / 4.5) and f["Bwd Packets/s"] == pytest.approx(4 / 4.5)
    assert f["Average Packet Size"] == f["Packet Length Mean"] == pytest.approx(700 / 9)
    assert (f["Avg Fwd Segment Size"], f["Avg Bwd Segment Size"], f["Down/Up Ratio"]) == (80.0, 75.0, 0.8)
    assert (f["SYN Flag Count"], f["ACK Flag Count"], f["FIN Flag Count"], f["URG Flag Count"]) == (1.0, 1.0, 0.0, 0.0)
    assert f["Subflow Bwd Bytes"] == 300.0 and f["Idle Min"] == 0.0


@pytest.mark.parametrize("start, end", [
    ("2024-01-01T00:00:05+0000", "2024-01-01T00:00:04+0000"), ("yesterday", "2024-01-01T00:00:04Z"), (None, "2024-01-01T00:00:04Z")])
def test_no_usable_duration(spark, start, end):
    record = flow(flow={"pkts_toserver": 1, "bytes_toserver": 10, "start": start, "end": end})
    f = features(spark, record)
    assert f["Flow Duration"] == 0.0 and f["Flow Bytes/s"] == 0.0 and f["Average Packet Size"] == 10.0


def test_counters_at_the_top_level_and_empty_flow(spark):
    f = features(spark, flow(flow=None, pkts_toserver=2, bytes_toserver=10, tcp=None))
    assert (f["Total Fwd Packets"], f["Avg Fwd Segment Size"], f["SYN Flag Count"]) == (2.0, 5.0, 0.0)
    f = features(spark, flow(flow={}, pkts_toserver=2))
    assert f["Total Fwd Packets"] == 0.0 and f["Down/Up Ratio"] == 0.0


def test_last_alert_wins_and_empty_signatures_do_not_count(spark):
    records = [alert(1, "A"), alert(1, "B"), alert(2, "A"), alert(2, None, "2024-01-01T00:00:02Z"), alert(None, "C"),
               flow(flow_id=1), flow(flow_id=2), flow(flow_id=3), flow(flow_id=None)]
    events = parse(spark, records)
    joined = OD.join_alerts(OD.flow_totals(L.flow_events(events)), OD.alert_index(L.alert_events(events)))
    got = {r.flow_id: (r.signature, r.signature_alert) for r in joined.collect()}
    assert got == {"1": ("B", True), "2": ("", False), "3": ("", False), None: ("", False)}


def test_defaults(spark):
    row = OD.flow_totals(L.flow_events(parse(spark, [flow(dest_port=None, timestamp=None, src_ip=None)]))).first()
    assert row.dst_port == 0 and row.src_ip == "" and row.ts is not None and row.bytes_total == 700.0


@pytest.mark.parametrize("signature, p, reason, verdict", [
    ("", 0.49, "none", "benign"), ("A", 0.49, "suricata", "attack_suricata_only"), ("", 0.5, "ml", "attack_ml_only"),
    ("A", 0.9, "suricata+ml", "attack_both"), ("A", None, "suricata", "attack_suricata_only"), ("", 0.49999999, "none", "benign")])
def test_fusion(spark, signature, p, reason, verdict):
    row = OD.fuse(spark.createDataFrame([(signature, p)], "signature string, model_proba double")).first()
    assert (row.fusion_reason, row.verdict) == (reason, verdict)
    assert row.fused_decision == (verdict != "benign") and row.model_proba == round(p or 0.0, 6)


def scorer(features):
    return features.withColumn("model_proba", finite_or_zero(quoted("Down/Up Ratio")))


def test_batch_job_and_report(spark, tmp_path):
    records = [alert(1, "LOCAL A"), flow(flow_id=1), flow(flow_id=2, flow={"pkts_toserver": 4, "pkts_toclient": 1, "bytes_toserver": 1}), "{bad"]
    path = tmp_path / "log"
    path.mkdir()
    (path / "events.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n\n")
    out = str(tmp_path / "out")
    counters = decision_batch_job(spark, str(path), scorer, out).first()
    assert tuple(counters)[:5] == (2, 1, 1, 1, 2) and counters.agreement_pct == 100.0
    stored = read_decisions_csv(spark, out)
    assert stored.schema == DECISION_BATCH
    rows = {r.suricata_alert: r for r in stored.collect()}
    assert rows[1].fusion_reason == "suricata+ml" and rows[1].timestamp == "2024-01-01T00:00:05.000000+0000"
    assert rows[0].suricata_signature in ("", None) and rows[0].ml_proba == 0.25 and rows[0].dst_port == "22"
    frame = OD.from_batch_records(stored)
    assert tuple(RP.detection_counts(frame).first()) == (2, 1, 1, 1, 0, 1)
    (tmp_path / "truth.csv").write_text("src_ip,is_attack\n172.16.0.5,1\n172.16.0.5,0\n1.1.1.1,1\n")
    table = {r.engine: (r.tp, r.fp, r.fn) for r in RP.ground_truth_eval(frame, read_ground_truth(spark, str(tmp_path / "truth.csv"))).collect()}
    assert table == {"signature": (1, 1, 1), "model": (1, 1, 1), "fused": (1, 1, 1)}
    other = spark.createDataFrame([("9.9.9.9", 1)], "src_ip string, is_attack int")
    assert RP.ground_truth_eval(frame, other).count() == 0


def test_live_layout(spark):
    decisions = decide(parse(spark, [alert(1, "S"), flow(flow_id=1)]), scorer)
    live = OD.live_records(decisions)
    assert [(f.name, f.dataType) for f in live.schema] == [(f.name, f.dataType) for f in DECISION_LIVE]
    row = live.first()
    assert row["duration_ms"] == 4.0 and row["pkts_total"] == 9 and row["suricata_alert"] is True and row["verdict"] == "attack_both"


def test_empty_decisions(spark):
    empty = OD.fuse(spark.createDataFrame([], "signature string, model_proba double"))
    assert tuple(DB.agreement_pct(empty).first()) == (0.0, 0.0)
    assert {tuple(r) for r in DB.agreement_matrix(empty).collect()} == {(a, m, 0, 0.0) for a in (0, 1) for m in (0, 1)}


def test_rules_on_logged_records(spark):
    record = {"timestamp": "2024-01-01T00:00:01Z", "event_type": "http", "src_ip": "10.0.0.1", "dest_port": 80, "proto": "TCP"}
    logins = [{**record, "http": {"http_method": "POST", "url": "/LOGIN.php"}}, {**record, "http": {"http_method": "GET", "url": "/login"}}]
    injections = [{**record, "http": {"http_method": "GET", "url": u}} for u in ("/?a=UNION+SELECT", "/?a=select+union", "/?a=%27+OR+1", "/?a=or%27")]
    ssh = [{**record, "event_type": "flow", "dest_port": 22, "timestamp": f"2024-01-01T00:00:0{i}Z"} for i in range(5)]
    few = [{**record, "event_type": "flow", "dest_port": 22, "src_ip": "10.0.0.2"} for _ in range(4)]
    hits = RU.apply_rules(RU.traffic_from_events(parse(spark, logins + injections + ssh + few)))
    got = {(r.sid, r.src_ip): r.hits for r in hits.groupBy("sid", "src_ip").agg(F.sum("hits").alias("hits")).collect()}
    assert got == {(1000010, "10.0.0.1"): 1, (1000020, "10.0.0.1"): 1, (1000021, "10.0.0.1"): 1, (1000030, "10.0.0.1"): 5}
    assert set(RU.as_alerts(hits).columns) == {"timestamp", "event_type", "src_ip", "alert", "sid"}
