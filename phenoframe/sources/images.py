"""Folders of dated photographs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoframe.functions import text as ft


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, bytes) of the files in ``folder`` and ``folder/aside``; nothing is read.

    The scan is not recursive. Leaving out the content column keeps file bodies unread.
    """
    base = folder.rstrip("/")
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .load(base)
        .select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
        .where(
            F.regexp_replace("path", "^file:/*", "/").rlike(
                "^" + "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in base) + "/(aside/)?[^/]+$"
            )
        )
    )


def parse_names(
    files: DataFrame, path: str = "path", template: str = "{group}.{date}", date_format: str = "%y-%m-%d",
    suffix: str = "_1", legacy: bool = False,
) -> DataFrame:
    """Add group_id and date from each file name; both are null when the name does not fit."""
    def read(found):
        date = ft.parse_date(ft.clean_date_text(found["date"], suffix, legacy), date_format)
        return ft.let(
            date,
            lambda d: F.struct(d.alias("date"), F.when(d.isNotNull(), F.nullif(found["group"], F.lit(""))).alias("group_id")),
        )

    parsed = ft.let(ft.template_fields(ft.file_stem(F.col(path)), template), read)
    return files.withColumn("_name", parsed).select("*", "_name.date", "_name.group_id").drop("_name")


def dated_series(files: DataFrame, path: str = "path", include_set_aside: bool = False, **options) -> DataFrame:
    """Images whose name carries a group and a date, with derived columns."""
    named = parse_names(files, path, **options).where("group_id is not null")
    series = named.select(
        "*",
        F.sha2(F.col(path), 256).alias("image_id"),
        ft.file_name(F.col(path)).alias("file_name"),
        ft.expected_code(F.col("group_id")).alias("expected_code"),
        ft.is_set_aside(F.col(path)).alias("set_aside"),
    )
    return series if include_set_aside else series.where("not set_aside")


def rejected_names(files: DataFrame, path: str = "path", **options) -> DataFrame:
    return parse_names(files, path, **options).where("group_id is null").drop("group_id", "date")


def read_camera_tags(spark: SparkSession, path: str) -> DataFrame:
    """Exported tag JSON, one object per line: (path, tags map, error).

    ``SourceFile`` names the image; tool messages are not tags.
    """
    tags = F.from_json("value", "map<string,string>")
    lines = spark.read.text(path).select(tags.alias("_t")).where("_t is not null")
    kept = F.map_filter("_t", lambda k, v: (k != "SourceFile") & ~k.startswith("ExifTool:"))
    error = F.coalesce(F.try_element_at("_t", F.lit("ExifTool:Error")), F.lit(""))
    return lines.select(F.try_element_at("_t", F.lit("SourceFile")).alias("path"), kept.alias("tags"), error.alias("error"))


def attach_tags(images: DataFrame, tags: DataFrame, path: str = "path") -> DataFrame:
    """Every image with its tags; images without a record get an error text."""
    joined = images.join(tags, path, "left")
    return joined.withColumn(
        "error", F.when(F.col("tags").isNull(), F.lit("No metadata returned for this file")).otherwise(F.col("error"))
    )
