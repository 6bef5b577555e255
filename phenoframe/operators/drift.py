"""Camera-setting drift inside a series.

Input is long: one row per (group, image, key) that has a value. A key that is missing from an
image counts as a value of its own. Nothing is cross-joined: the number of missing images per
key follows from the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def tags_to_long(images: DataFrame, group: str, image: str, tags: str) -> DataFrame:
    return images.select(group, image, F.explode(F.map_entries(tags)).alias("_e")).select(
        group, image, F.col("_e.key").alias("key"), F.col("_e.value").alias("value")
    ).where("value is not null")


def value_tally(tags: DataFrame, images: DataFrame, group: str, image: str) -> DataFrame:
    """Images per (group, key, value), with a null value for images lacking the key."""
    counts = tags.groupBy(group, "key", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = images.groupBy(group).agg(F.count_distinct(image).alias("_total"))
    missing = (
        counts.groupBy(group, "key").agg(F.sum("n").alias("_present"))
        .join(totals, group)
        .where("_total > _present")
        .select(group, "key", F.lit(None).cast("string").alias("value"), (F.col("_total") - F.col("_present")).alias("n"))
    )
    return counts.unionByName(missing)


def tally_text(tally: DataFrame, group: str) -> DataFrame:
    """``value (count); value (count)`` per key, in value order, missing last."""
    entry = F.struct(
        F.col("value").isNull().alias("missing"), F.col("value").alias("value"), F.col("n").alias("n")
    )
    text = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(entry)),
            lambda e: F.concat(F.coalesce(e["value"], F.lit("(missing)")), F.lit(" ("), e["n"].cast("string"), F.lit(")")),
        ),
        "; ",
    )
    return tally.groupBy(group, "key").agg(text.alias("tally"))


def key_modes(tally: DataFrame, group: str) -> DataFrame:
    """Per key: is it unanimous, is the mode unique, and which value is it."""
    by_count = tally.groupBy(group, "key", "n").agg(
        F.count(F.lit(1)).alias("k"), F.max("value").alias("v")
    )
    return by_count.groupBy(group, "key").agg(
        (F.sum("k") == 1).alias("same"),
        (F.max_by("k", "n") == 1).alias("unique_mode"),
        F.max_by("v", "n").alias("mode"),
    ).withColumn("mode", F.when(F.col("unique_mode"), F.col("mode")))


def deviations(tags: DataFrame, images: DataFrame, group: str, image: str) -> DataFrame:
    """(group, image, key, value) of every image that leaves the unique mode of a key.

    When the highest count is shared by several values there is no mode to follow, so every
    image of the group is reported for that key.
    """
    tally = value_tally(tags, images, group, image)
    modes = key_modes(tally, group).where("not same")
    present = (
        tags.join(modes, [group, "key"])
        .where(~F.col("unique_mode") | ~F.col("value").eqNullSafe(F.col("mode")))
        .select(group, image, "key", "value")
    )
    gaps = tally.where("value is null").select(group, "key")
    absent = (
        modes.join(gaps, [group, "key"], "left_semi")
        .where(~F.col("unique_mode") | F.col("mode").isNotNull())
        .select(group, "key")
        .join(images.select(group, image).distinct(), group)
        .join(tags.select(group, image, "key"), [group, image, "key"], "left_anti")
        .select(group, image, "key", F.lit(None).cast("string").alias("value"))
    )
    return present.unionByName(absent)


def image_warnings(
    deviating: DataFrame, images: DataFrame, group: str, image: str, error: str, has_tags: str
) -> DataFrame:
    """Warning text per image; groups with an unread image are left out."""
    unread = images.where(~F.col(has_tags)).select(group).distinct()
    keys = deviating.groupBy(group, image).agg(F.sort_array(F.collect_list("key")).alias("_keys"))
    differs = F.when(F.col("_keys").isNotNull(), F.concat(F.lit("Metadata differs: "), F.array_join("_keys", ", ")))
    failed = F.when(F.col(error) != "", F.concat(F.lit("Metadata read warning: "), F.col(error)))
    return (
        images.join(unread, group, "left_anti")
        .join(keys, [group, image], "left")
        .select(group, image, F.concat_ws("; ", differs, failed).alias("warning"))
        .where("warning <> ''")
    )
