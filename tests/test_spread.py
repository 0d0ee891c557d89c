"""Large steps are dealt over tasks, whatever the layout of the table they start from."""

import glob

from pyspark.sql import functions as F

from tidegate.catalog import eventlog, io, streams
from tidegate.catalog import surrogates as S
from tidegate.session import scratch_path
from tidegate.sinks import batch_log

SF = "/root/testdata/sf0.001"


def test_log_lines_are_formatted_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "EVENTS_PER_TASK", 100)
    path = scratch_path(spark, "lines")
    S.log_lines(spark, SF).write.text(path)
    files = glob.glob(f"{path.removeprefix('file:')}/part-*")
    assert len(files) >= 5
    for file in files:
        lines = spark.read.text(file).select(
            F.get_json_object("value", "$.flow_id").alias("f"), F.get_json_object("value", "$.event_type").alias("k")).collect()
        flows = set()
        for line in lines:
            assert line.k == "flow" or line.f not in flows
            flows |= {line.f} if line.k == "flow" else set()


def test_batches_are_written_by_many_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(batch_log, "ROWS_PER_FILE", 100)
    rows = spark.range(1000).coalesce(1)
    table = batch_log.Table("numbers", rows.schema)
    log = batch_log.BatchLog(spark, str(tmp_path))
    assert log.write(0, [(table, (rows, 1000))])
    assert len(glob.glob(f"{tmp_path}/numbers/*/part-*")) == 10
    assert sorted(r.id for r in log.read(table).collect()) == list(range(1000))


def test_the_log_is_made_once(spark, monkeypatch):
    made, real = [], S.log_lines
    monkeypatch.setattr(S, "log_lines", lambda *a: made.append(1) or real(*a))
    assert eventlog._fitted_batch_job(spark, SF).first().counters_agree and len(made) == 1


def test_phases_read_one_stored_log(spark, monkeypatch):
    stored, real = [], streams.stage
    monkeypatch.setattr(streams, "stage", lambda *a: stored.append(a[1]) or real(*a))
    assert {r.event_type for r in streams._scan(spark, SF).collect()} == {"flow", "alert"} and stored == ["lines"]


def test_flow_files_are_cut_by_rows(spark, monkeypatch):
    whole = {tuple(r) for r in io._scan_flow_csv(spark, SF).collect()}
    monkeypatch.setattr(io, "ROWS_PER_FILE", 50)
    paths, real = [], io.discover
    monkeypatch.setattr(io, "discover", lambda s, p: paths.append(p) or real(s, p))
    cut = [tuple(r) for r in io._scan_flow_csv(spark, SF).collect()]
    assert set(cut) == whole and len(cut) == len(whole) == 16
    assert real(spark, paths[0]).count() > 64


def test_few_rows_of_a_large_frame_are_found_by_many_tasks(spark, tmp_path):
    """The filter runs before the rows are brought together: a coalesce to one file would run it in one task."""
    task = F.udf(lambda i: __import__("pyspark").TaskContext.get().partitionId(), "int")
    rows = spark.range(0, 1000, 1, 8).filter("id % 100 = 0").select("id", task("id").alias("task"))
    table = batch_log.Table("few", rows.schema)
    log = batch_log.BatchLog(spark, str(tmp_path))
    log.write(0, [(table, (rows, 10))])
    assert len({r.task for r in log.read(table).collect()}) > 4
    assert len(glob.glob(f"{tmp_path}/few/*/part-*")) == 1
