"""Session construction and the two ways this library pins intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SMALL_TABLE_ROWS = 100_000


def build_session(app_name: str = "tidegate", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; `conf` keys use `_` for `.`."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's setting, or a temporary one in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="tidegate-ckpt-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Materialise reliably and cut the lineage, so lost executors cannot change the result."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def small_table(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Evaluate a table expected to be small exactly once.

    Up to `max_rows` rows it becomes a local relation of known size, which Spark's own
    broadcast threshold then judges; beyond that it is checkpointed and joins shuffle.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return pin(df)
    return df.sparkSession.createDataFrame(rows, schema=df.schema)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a large intermediate once and read it back, so later passes prune its columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def fit_input(df: DataFrame, name: str = "fit") -> Iterator[DataFrame]:
    """Rows for an iterative fit: staged, so that each step plans from a plain scan, and cached."""
    rows = stage(df, name).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()
