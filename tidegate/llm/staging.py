"""Intermediate tables of these operators: written once below the shared checkpoint folder and reread."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidegate.session import scratch_path

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released_shuffles(spark: SparkSession):
    """Within this block Spark drops a job's shuffle files when the job has ended."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


class Stage:
    """A written table: `read()` gives it back in any later job, `drop()` frees its disk."""

    def __init__(self, df: DataFrame, name: str, partition_by: str | None = None):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with released_shuffles(self.spark):
            writer.parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Only after every table made from this one has been written itself."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
