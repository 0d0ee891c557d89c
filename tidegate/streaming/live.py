"""The live job: log in, decisions out, counters on the side; and the dashboard streams.

Every flow is scored and decided in the micro-batch that brings it, however late its time is. Alerts that wait for
their flow are a small table, committed together with the decisions of each batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidegate.operators import decisions as OD
from tidegate.operators.dashboards import rate_buckets, totals_columns
from tidegate.plans.bridge import Scorer, score_flows
from tidegate.schemas import DECISION_BATCH, DECISION_LIVE
from tidegate.sinks.batch_log import BatchLog, Table
from tidegate.sources.event_log import flow_events, well_formed
from tidegate.streaming.correlate import DEFAULT_TTL_SECONDS, WAITING, still_waiting, take_alerts
from tidegate.streaming.source import DEFAULT_DELAY, behind_watermark, log_stream

DOCUMENTS = Table("documents", DECISION_LIVE, "json")
MIRROR = Table("mirror", DECISION_BATCH, "csv", {"header": "true", "emptyValue": ""})
COUNTERS = Table("counters", T.StructType([
    *[T.StructField(c, T.LongType()) for c in ("batch", "flows", "alerted", "model_flagged", "fused", "agreement", "late")],
    T.StructField("newest", T.TimestampType())]))
PENDING = Table("pending", WAITING, replaced=True)


def matched_flows(batch: DataFrame, waiting: DataFrame, ttl_seconds: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Flows and alerts of a micro-batch of parsed records, in log order: see `take_alerts`."""
    seq = F.struct("place", F.monotonically_increasing_id().alias("row"))
    events = batch.withColumn("seq", seq)
    flows = OD.flow_totals(flow_events(events), ["arrived"])
    alerts = well_formed(events).filter(F.col("event_type") == "alert").select(
        "flow_id", "seq", "arrived", F.coalesce("alert.signature", F.lit("")).alias("signature"))
    return take_alerts(flows, alerts, waiting, ttl_seconds)


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint keeps through restarts: batch numbers are its own."""
    return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


class DecisionWriter:
    """Commits micro-batches of a decision frame: documents, CSV mirror, counters, and what else belongs to them."""

    def __init__(self, spark: SparkSession, out: str, checkpoint: str, delay: str = DEFAULT_DELAY):
        self.spark, self.out, self.checkpoint, self.delay = spark, out, checkpoint, delay

    def log(self) -> BatchLog:
        return BatchLog(self.spark, self.out, checkpoint_id(self.spark, self.checkpoint))

    def counted(self, decisions: DataFrame, newest: str | None) -> Row:
        """Counters of the batch; a flow is late if it is older than the newest one of earlier batches by the delay."""
        late = F.col("ts") < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {self.delay}")
        return decisions.agg(*OD.counter_columns(), F.count_if(late).alias("late"), F.max("ts").alias("newest")).first()

    def write(self, decisions: DataFrame, number: int, extra: Callable[[], list] = list) -> bool:
        """False if the batch was committed before. `decisions` should be persisted."""
        log = self.log()
        state = log.state()
        newest = state["facts"].get("newest")
        row = self.counted(decisions, newest)
        seen = max(filter(None, [newest, row.newest and row.newest.isoformat(" ")]), default=None)
        counters = self.spark.createDataFrame([(number, *row)], COUNTERS.schema)
        rows = [(DOCUMENTS, (OD.live_records(decisions), row.flows)), (MIRROR, (OD.batch_records(decisions), row.flows)),
                (COUNTERS, (counters, 1)), *[(table, cell) for table, cell in extra()]]
        return log.write(number, rows, {"newest": seen})

    def __call__(self, decisions: DataFrame, number: int) -> None:
        """For `foreachBatch` of a decision stream."""
        if self.log().has(number):
            return
        kept = decisions.persist()
        try:
            self.write(kept, number)
        finally:
            kept.unpersist()


class LiveBatch(DecisionWriter):
    """For `foreachBatch` of a stream of parsed records: matches, scores, decides and commits."""

    def __init__(self, spark: SparkSession, out: str, checkpoint: str, scorer: Scorer, threshold: float = 0.5,
                 ttl_seconds: int = DEFAULT_TTL_SECONDS, delay: str = DEFAULT_DELAY):
        super().__init__(spark, out, checkpoint, delay)
        self.scorer, self.threshold, self.ttl_seconds = scorer, threshold, ttl_seconds

    def __call__(self, batch: DataFrame, number: int) -> None:
        log = self.log()
        if log.has(number):
            return
        events = batch.persist()
        taken = matched_flows(events, log.read(PENDING), self.ttl_seconds).persist()
        flows = taken.filter("_flow").drop("_flow", "arrived")
        decisions = OD.fuse(score_flows(flows, self.scorer), self.threshold).persist()
        try:
            now = taken.agg(F.max("arrived")).first()[0]
            waiting = still_waiting(taken, now, self.ttl_seconds)
            self.write(decisions, number, lambda: [(PENDING, (waiting, waiting.count()))])
        finally:
            for kept in (decisions, taken, events):
                kept.unpersist()


def stream_decisions(
    spark: SparkSession, landing: str | DataFrame, scorer: Scorer, out: str, checkpoint: str, threshold: float = 0.5,
    delay: str = DEFAULT_DELAY, once: bool = False, from_end=None, files_per_trigger: int | None = None,
    ttl_seconds: int = DEFAULT_TTL_SECONDS,
) -> StreamingQuery:
    """Starts the live job on a landing folder, or on a stream of parsed records. `once` processes what is there.

    `delay` only says which flows count as late; they are decided like all others.
    """
    events = landing if isinstance(landing, DataFrame) else log_stream(spark, landing, from_end, files_per_trigger)
    job = LiveBatch(spark, out, checkpoint, scorer, threshold, ttl_seconds, delay)
    return _started(events, job, checkpoint, once)


def sink_decisions(decisions: DataFrame, out: str, checkpoint: str, delay: str = DEFAULT_DELAY, once: bool = False) -> StreamingQuery:
    """Writes a stream of decision frames: documents, mirror, counters."""
    return _started(decisions, DecisionWriter(decisions.sparkSession, out, checkpoint, delay), checkpoint, once)


def _started(stream: DataFrame, job, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.queryName("decisions").outputMode("append").option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": "10 seconds"}
    return writer.foreachBatch(job).trigger(**trigger).start()


def finish(query: StreamingQuery, timeout: int = 600) -> StreamingQuery:
    """Waits for the end of a run over what is there."""
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream did not finish within {timeout} s")
    return query


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    return BatchLog(spark, out).read(DOCUMENTS)


def read_mirror(spark: SparkSession, out: str) -> DataFrame:
    return BatchLog(spark, out).read(MIRROR)


def progress_summary(spark: SparkSession, out: str) -> DataFrame:
    """Counters of every committed micro-batch since the start, late flows included."""
    return OD.with_agreement(BatchLog(spark, out).read(COUNTERS))


def stream_flow_rate(decisions: DataFrame, delay: str = DEFAULT_DELAY, seconds: int = 5) -> DataFrame:
    """Tumbling buckets with a column per verdict; a bucket appears once the watermark has passed it.

    Rows without a verdict are heartbeats: they move the watermark, so that the last buckets come out too.
    """
    marked = decisions.withColumn("_kind", F.when(F.col("verdict").isNull(), F.lit("")).otherwise(F.lit("flow")))
    return rate_buckets(behind_watermark(marked, "ts", delay, "_kind", "flow"), seconds)


def stream_session_totals(decisions: DataFrame) -> DataFrame:
    """Running totals since the start: one row, for complete mode."""
    return decisions.agg(*totals_columns())


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", timeout: int = 600) -> StreamingQuery:
    """Processes all present input into a parquet table at `out` and waits for the end."""
    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return finish(writer.foreachBatch(replace).start() if mode == "complete" else writer.format("parquet").start(out), timeout)
