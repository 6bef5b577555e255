"""Result tables, stage tables and document copies."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoframe.schema import STATS


def conform(stats: DataFrame) -> DataFrame:
    """Cast to the fixed result columns, adding missing ones as null."""
    have = set(stats.columns)
    return stats.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in STATS.fields
        ]
    )


def write_statistics(stats: DataFrame, target: str, has_overrides: bool, mode: str = "errorifexists") -> None:
    """CSV with header; the two override columns appear only when there are overrides."""
    out = conform(stats)
    if not has_overrides:
        out = out.drop("root_source", "rsml_plant_id")
    out.write.mode(mode).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(target)


def merge_results(current: DataFrame, recomputed: DataFrame, group: str) -> DataFrame:
    """Stored rows of current groups plus the recomputed groups."""
    kept = current.join(recomputed.select(group).distinct(), group, "left_anti")
    return kept.unionByName(recomputed, allowMissingColumns=True)


def save_stage(df: DataFrame, target: str, group: str = "group_id") -> None:
    """Replace only the partitions of the groups in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(target)


def load_stage(spark: SparkSession, target: str, columns=None) -> DataFrame:
    stage = spark.read.parquet(target)
    return stage.select(*columns) if columns else stage


def append_overrides(rows: DataFrame, target: str) -> None:
    rows.write.mode("append").parquet(target)


def save_masks(mask: DataFrame, groups: DataFrame, target: str, group: str = "group_id") -> None:
    """Replace the stored masks of ``groups`` by their pixels (group, width, height, x, y); other groups stay as they are.

    A group without pixels gets one row of nulls, so its former mask goes; pixels of groups that are not listed are not written.
    """
    rows = groups.select(group).distinct().join(mask.select(group, "width", "height", "x", "y"), group, "left")
    save_stage(rows, target, group)


def load_masks(spark: SparkSession, target: str) -> DataFrame:
    """Pixels of all stored masks."""
    return load_stage(spark, target).where("x is not null")


def delete_mask(mask: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    return mask.join(groups.select(group).distinct(), group, "left_anti")


def write_documents(documents: DataFrame, folder: str) -> None:
    """Byte-exact copies of (file_name, source) on a file system all executors share.

    A file is written under a task-specific name and then renamed, so a retried task leaves no
    half-written copy. A name that holds a separator or is a relative step is refused.
    """
    def copy(rows):
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            if not row.file_name or os.path.basename(row.file_name) != row.file_name or row.file_name in (".", "..") or "\\" in row.file_name:
                raise ValueError(f"not a plain file name: {row.file_name!r}")
            temporary = os.path.join(folder, f".{row.file_name}.{os.getpid()}")
            with open(temporary, "wb") as stream:
                stream.write(bytes(row.source))
            os.replace(temporary, os.path.join(folder, row.file_name))

    documents.select("file_name", "source").foreachPartition(copy)


def write_parameters(spark: SparkSession, params, target: str) -> None:
    """Run parameters as one JSON row beside the results."""
    spark.createDataFrame([(params.to_json(),)], "value string").write.mode("errorifexists").text(target)
