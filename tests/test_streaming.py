import json
import os

from pyspark.sql import functions as F
from test_events import alert, flow, scorer

from tidegate.session import scratch_path
from tidegate.sinks.batch_log import BatchLog, Table
from tidegate.sources import log_follower
from tidegate.streaming import correlate, live, source


def land(folder, name, records):
    folder.mkdir(exist_ok=True)
    temporary = folder.parent / name
    temporary.write_text("\n".join(json.dumps(r) for r in records) + "\n")
    temporary.rename(folder / name)


def at(second):
    return f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}.000000Z"


def decided(spark, landing, state, out, minute=0, ttl=600):
    """One run of the live job over what has landed; all flows decided so far."""
    arrived = F.lit(f"2024-01-01 00:{minute:02d}:00").cast("timestamp")
    events = source.log_stream(spark, str(landing), arrived=arrived)
    live.finish(live.stream_decisions(spark, events, scorer, out, state, once=True, ttl_seconds=ttl, delay="10 seconds"))
    rows = live.read_documents(spark, out).collect()
    return sorted((r.flow_id, r["@timestamp"][14:19], r.suricata_signature or "") for r in rows)


def test_alerts_are_used_once_newest_first_across_batches(spark, tmp_path):
    landing = tmp_path / "landing"
    state, out = scratch_path(spark, "state"), scratch_path(spark, "out")
    land(landing, "a.json", [
        alert(1, "S1", at(1)), alert(1, "S2", at(2)), flow(flow_id=1, timestamp=at(5)), flow(flow_id=1, timestamp=at(6)),
        flow(flow_id=2, timestamp=at(3)), alert(2, "after", at(4)), alert(3, "waits", at(5)), alert(None, "no flow", at(5)),
        flow(flow_id=None, timestamp=at(7)), alert(4, "old", at(5)), alert(4, "", at(6)),
    ])
    first = [("", "00:07", ""), ("1", "00:05", "S2"), ("1", "00:06", ""), ("2", "00:03", "")]
    assert decided(spark, landing, state, out) == first
    land(landing, "b.json", [flow(flow_id=3, timestamp=at(9)), flow(flow_id=2, timestamp=at(9)), flow(flow_id=4, timestamp=at(9))])
    later = [("2", "00:09", "after"), ("3", "00:09", "waits"), ("4", "00:09", "")]
    assert decided(spark, landing, state, out, 9) == sorted(first + later)
    # used up; and a batch without new files
    land(landing, "c.json", [flow(flow_id=3, timestamp=at(10))])
    assert decided(spark, landing, state, out, 9) == sorted([*first, *later, ("3", "00:10", "")])
    assert decided(spark, landing, state, out, 9) == sorted([*first, *later, ("3", "00:10", "")])


def test_alerts_run_out_of_time(spark, tmp_path):
    landing, state, out = tmp_path / "landing", scratch_path(spark, "state"), scratch_path(spark, "out")
    land(landing, "a.json", [alert(1, "S1", at(1)), alert(2, "S2", at(1)), alert(3, "S3", at(1))])
    decided(spark, landing, state, out, 0)
    land(landing, "b.json", [flow(flow_id=1, timestamp=at(2))])
    assert decided(spark, landing, state, out, 10) == [("1", "00:02", "S1")]
    land(landing, "c.json", [flow(flow_id=2, timestamp=at(3)), alert(3, "again", at(1))])
    assert decided(spark, landing, state, out, 11) == [("1", "00:02", "S1"), ("2", "00:03", "")]
    assert [r.signature for r in BatchLog(spark, out).read(live.PENDING).collect()] == ["again"]


def test_late_flows_are_decided_and_counted(spark, tmp_path):
    landing, state, out = tmp_path / "landing", scratch_path(spark, "state"), scratch_path(spark, "out")
    land(landing, "a.json", [flow(flow_id=1, timestamp=at(60)), flow(flow_id=2, timestamp=at(2))])
    decided(spark, landing, state, out)
    land(landing, "b.json", [alert(3, "S", at(1)), flow(flow_id=3, timestamp=at(3)), flow(flow_id=4, timestamp=at(50)),
                             flow(flow_id=5, timestamp=at(49))])
    rows = decided(spark, landing, state, out)
    assert len(rows) == 5 and ("3", "00:03", "S") in rows
    counters = {r.batch: r for r in live.progress_summary(spark, out).collect()}
    assert [(counters[b].flows, counters[b].late, counters[b].alerted) for b in (0, 1)] == [(2, 0, 0), (3, 2, 1)]


def test_a_hundred_batches_leave_few_files(spark, tmp_path):
    out = str(tmp_path / "sink")
    table = Table("rows", spark.range(0).schema)
    last = Table("last", spark.range(0).schema, "json", replaced=True)
    for number in range(101):
        log = BatchLog(spark, out, "run")
        assert log.write(number, [(table, (spark.range(number * 3, number * 3 + 3), 3)), (last, (spark.range(1), 1))])
        assert log.has(number) and not log.has(number + 1)
    before = log.state()
    assert not log.write(100, [(table, (spark.range(5), 5))]) and log.state() == before
    assert sorted(r.id for r in log.read(table).collect()) == list(range(303))
    assert log.read(last).count() == 1
    files = [f for _, _, names in os.walk(out) for f in names if f.startswith("part-")]
    assert len(before["tables"]["rows"]) <= 12 and len(files) <= 50
    # another run numbers its own batches
    assert BatchLog(spark, out, "other").write(0, [(table, (spark.range(1), 1))])
    assert log.read(table).count() == 304


def test_a_batch_that_was_cut_off_is_written_again(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "sink")
    table = Table("rows", spark.range(0).schema)
    log = BatchLog(spark, out, "run")
    with monkeypatch.context() as patch:
        def fail(state):
            raise OSError("lost")

        patch.setattr(log, "_commit", fail)
        try:
            log.write(0, [(table, (spark.range(9), 9))])
        except OSError:
            pass
    assert log.read(table).count() == 0
    assert log.write(0, [(table, (spark.range(4), 4))])
    assert log.read(table).count() == 4


def test_mirror_and_documents_agree(spark, tmp_path):
    landing, state, out = tmp_path / "landing", scratch_path(spark, "state"), scratch_path(spark, "out")
    land(landing, "a.json", [alert(1, "S", at(1)), flow(flow_id=1, timestamp=at(2)), flow(flow_id=2, timestamp=at(3))])
    decided(spark, landing, state, out)
    rows = {r.flow_id: r for r in live.read_documents(spark, out).collect()}
    assert rows["1"].suricata_signature == "S" and rows["1"].verdict == "attack_both"
    mirror = live.read_mirror(spark, out)
    assert mirror.count() == 2 and "timestamp" in mirror.columns
    assert sorted(r.suricata_alert for r in mirror.collect()) == [0, 1]


def test_start_from_end_skips_older_files(spark, tmp_path):
    from datetime import datetime, timedelta

    landing = tmp_path / "landing"
    land(landing, "a.json", [flow(flow_id=1)])
    events = source.log_stream(spark, str(landing), from_end=datetime.now() + timedelta(hours=1)).select("flow_id")
    out = scratch_path(spark, "out")
    live.run_available(events, out, scratch_path(spark, "state"))
    assert spark.read.schema("flow_id string").parquet(out).count() == 0


def followed(spark, path, state, out, from_end=False):
    """All lines that runs over `path` have read so far, in the order of runs."""
    live.run_available(log_follower.follow(spark, path, from_end).select("value"), out, state, timeout=120)
    return sorted(r.value for r in spark.read.schema("value string").parquet(out).collect())


def test_growing_truncated_and_rotated_logs_give_each_line_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_follower, "RANGE_BYTES", 7)
    log, state, out = tmp_path / "eve.json", scratch_path(spark, "state"), scratch_path(spark, "out")
    path = f"{log}*"
    log.write_text("first\nsecond line\nthi")
    assert followed(spark, path, state, out) == ["first", "second line"]
    with log.open("a") as file:
        file.write("rd\n\nfourth é\n")
    want = ["", "first", "fourth é", "second line", "third"]
    assert followed(spark, path, state, out) == want
    assert followed(spark, path, state, out) == want
    # renamed with unread lines, a new file in its place
    with log.open("a") as file:
        file.write("before the move\n")
    log.rename(tmp_path / "eve.json.1")
    log.write_text("new file\n")
    want = sorted([*want, "before the move", "new file"])
    assert followed(spark, path, state, out) == want
    # cut short in place, with another first line and with the same one
    log.write_text("after the cut\nmore\n")
    want = sorted([*want, "after the cut", "more"])
    assert followed(spark, path, state, out) == want
    log.write_text("after the cut\n")
    want = sorted([*want, "after the cut"])
    assert followed(spark, path, state, out) == want


def test_following_from_the_end(spark, tmp_path):
    log, state, out = tmp_path / "eve.json", scratch_path(spark, "state"), scratch_path(spark, "out")
    log.write_text("old\n")
    assert followed(spark, str(log), state, out, from_end=True) == []
    with log.open("a") as file:
        file.write("new\n")
    assert followed(spark, str(log), state, out, from_end=True) == ["new"]


def test_live_job_on_a_followed_log(spark, tmp_path):
    log, state, out = tmp_path / "eve.json", scratch_path(spark, "state"), scratch_path(spark, "out")
    steps = [[alert(1, "S", at(5)), flow(flow_id=1, timestamp=at(1)), alert(2, "T", at(2))],
             [flow(flow_id=2, timestamp=at(1)), flow(flow_id=1, timestamp=at(9))]]
    for records in steps:
        with log.open("a") as file:
            file.write("".join(json.dumps(r) + "\n" for r in records))
        live.finish(live.stream_decisions(spark, source.followed_log(spark, str(log)), scorer, out, state, once=True))
    rows = live.read_documents(spark, out).collect()
    assert sorted((r.flow_id, r.suricata_signature or "") for r in rows) == [("1", ""), ("1", "S"), ("2", "T")]


def test_heartbeats_close_the_interval_join(spark, tmp_path):
    landing, state, out = tmp_path / "landing", scratch_path(spark, "state"), scratch_path(spark, "out")

    def run():
        events = source.log_stream(spark, str(landing))
        joined = correlate.interval_join(source.flow_stream(events, "10 seconds"), source.alert_stream(events, "10 seconds"))
        live.run_available(joined.select("flow_id", "signature"), out, state)
        return sorted((r.flow_id or "", r.signature) for r in spark.read.parquet(out).collect())

    land(landing, "a.json", [alert(1, "S", at(1)), flow(flow_id=1, timestamp=at(2)), flow(flow_id=2, timestamp=at(2)),
                             flow(flow_id=None, timestamp=at(2))])
    assert run() == [("1", "S")]
    source.heartbeat_line(spark, "2024-01-02T00:00:00.000000Z").write.mode("append").text(str(landing))
    assert run() == [("", ""), ("1", "S"), ("2", "")]


def test_interval_join_reduction(spark):
    rows = [("1", "A", 1), ("1", "B", 2), ("2", "", None)]
    df = spark.createDataFrame(rows, "flow_id string, signature string, alert_ts int")
    got = {r.flow_id: r.signature for r in correlate.last_alert_per_flow(df).collect()}
    assert got == {"1": "B", "2": ""}
