"""Session helpers: where iterative jobs cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, taken from ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost together with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    root = spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    root = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The returned plan is a plain Parquet scan: lineage is short, file statistics feed the
    optimizer, and a lost executor costs a re-read rather than a recomputation of the loop.
    """
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/phenoframe/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal ``df`` by ``keys`` to as many tasks as shuffles have.

    Adaptive execution judges partitions by their bytes and joins small ones into a single task. That is wrong before
    steps whose work is large for few bytes: Python on groups, or rows that expand to many.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
