"""Session settings and shared-folder tables of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phenoframe.runtime import cut

__all__ = ["arrow_batches", "cut", "partitions"]


def arrow_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Bound the Arrow batches that a Python task holds, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
