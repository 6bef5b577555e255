"""Measurements per plant and image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from phenoframe.functions import geometry as fg


def plant_slots(plants: DataFrame, doc: Sequence[str], position: str, plant_id: str) -> DataFrame:
    """Slot number per plant: its own id when the ids are exactly 1..n, else its position.

    Only counts, minimum and maximum are needed: n different whole numbers from 1 to n.
    """
    number = F.when(F.col(plant_id).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(plant_id).try_cast("int"))
    rows = plants.withColumn("_id", number)
    facts = rows.groupBy(*doc).agg(
        (
            (F.count("_id") == F.count(F.lit(1))) & (F.count_distinct("_id") == F.count(F.lit(1)))
            & (F.min("_id") == 1) & (F.max("_id") == F.count(F.lit(1)))
        ).alias("numeric_slots")
    ).withColumn("numeric_slots", F.coalesce("numeric_slots", F.lit(False)))
    return rows.join(facts, list(doc)).select(
        *doc, position, plant_id,
        F.when(F.col("numeric_slots"), F.col("_id")).otherwise(F.col(position) + 1).cast("int").alias("slot"),
        "numeric_slots",
    )


def axis_geometry(axes: DataFrame, points: str = "points") -> DataFrame:
    """Add length, depth and base point of array-valued polylines."""
    line = F.col(points)
    return axes.select(
        "*", fg.polyline_length(line).alias("length"), fg.polyline_depth(line).alias("depth"),
        F.get(F.get(line, F.lit(0)), F.lit(0)).alias("base_x"), F.get(F.get(line, F.lit(0)), F.lit(1)).alias("base_y"),
    )


def override_measures(axes: DataFrame, plant: Sequence[str], index: str, parent: str) -> DataFrame:
    """Per plant: total length, axis count and the longest primary axis.

    Needs length, depth, base_x, base_y. Equal longest axes resolve to the first in document order.
    """
    primary = F.col(parent).isNull()
    rank = F.when(primary, F.struct(F.col("length"), -F.col(index)))
    main = F.max_by(F.struct("length", "depth", "base_x", "base_y"), rank)
    out = axes.groupBy(*plant).agg(
        F.count(F.lit(1)).alias("plant_root_count"), F.sum("length").alias("plant_total_length"), main.alias("_m")
    )
    return out.select(
        *plant, "plant_root_count", "plant_total_length",
        F.coalesce("_m.depth", F.lit(0.0)).alias("plant_main_root_depth"),
        F.coalesce("_m.length", F.lit(0.0)).alias("plant_main_root_length"),
        F.col("_m.base_x").alias("plant_center_x"), F.col("_m.base_y").alias("plant_center_y"),
    )


def plant_totals(axes: DataFrame, plant: Sequence[str], parent: str) -> DataFrame:
    """Primary and lateral counts and lengths."""
    primary = F.col(parent).isNull()
    return axes.groupBy(*plant).agg(
        F.count_if(primary).alias("n_primary"), F.count_if(~primary).alias("n_lateral"),
        F.sum("length").alias("total_length"),
        F.coalesce(F.sum(F.when(~primary, F.col("length"))), F.lit(0.0)).alias("lateral_length"),
        F.max(F.when(primary, F.col("depth"))).alias("main_depth"),
    )


def document_report(axes: DataFrame, doc: Sequence[str]) -> DataFrame:
    """Inspection counts of every document: plants, axes, points and lengths."""
    return axes.groupBy(*doc).agg(
        F.count_distinct("plant_index").alias("n_plants"), F.count(F.lit(1)).alias("n_axes"),
        F.sum("n_points").alias("n_points"), F.sum("length").alias("total_length"), F.max("length").alias("longest"),
    )


def plant_origins(stems: DataFrame, group: Sequence[str], overridden: str) -> DataFrame:
    """Shared origin per slot: rounded median over the frames that are not overridden.

    Slots never seen are skipped and later slots move up. Positions are counted first, so the
    exact median is taken over distinct positions.
    """
    used = stems.where(~F.col(overridden))

    def median(axis):
        counts = used.groupBy(*group, "slot", axis).agg(F.count(F.lit(1)).alias("_n"))
        middle = F.percentile(axis, F.lit(0.5), F.col("_n"))
        return counts.groupBy(*group, "slot").agg(F.bround(middle).cast("int").alias(axis))

    both = median("x").join(median("y"), [*group, "slot"])
    order = Window.partitionBy(*group).orderBy("slot")  # one row per plant slot
    return both.select(*group, (F.row_number().over(order) - 1).alias("slot"), "x", "y")


def image_totals(area: DataFrame, skeleton: DataFrame, image: Sequence[str]) -> DataFrame:
    """Foreground pixels and skeleton pixels per image."""
    a = area.groupBy(*image).agg(F.count(F.lit(1)).alias("image_total_area"))
    s = skeleton.groupBy(*image).agg(F.count(F.lit(1)).alias("image_total_length"))
    return a.join(s, list(image), "full_outer").na.fill(0, ["image_total_area", "image_total_length"])


def owned_lengths(owned: DataFrame, main: DataFrame, image: Sequence[str], plant: str) -> DataFrame:
    """Distinct pixels per owner; a shared pixel counts once for each of its owners."""
    def size(px, name):
        return px.select(*image, plant, "x", "y").distinct().groupBy(*image, plant).agg(F.count(F.lit(1)).alias(name))

    tops = owned.groupBy(*image, plant).agg(F.min("y").alias("_top"))
    tips = main.groupBy(*image, plant).agg(F.max("y").alias("_tip"))
    return (
        size(owned, "plant_total_length").join(size(main, "plant_main_root_length"), [*image, plant], "left")
        .join(tops, [*image, plant], "left").join(tips, [*image, plant], "left")
        .select(
            *image, plant, "plant_total_length",
            F.coalesce("plant_main_root_length", F.lit(0)).alias("plant_main_root_length"),
            F.coalesce(F.col("_tip") - F.col("_top"), F.lit(0)).alias("plant_main_root_depth"),
        )
    )


def root_counts(owned_segments: DataFrame, links: DataFrame, image: Sequence[str], plant: str) -> DataFrame:
    """``root_count``: owned segments whose lower end is not the top of a linked child.

    ``tip_count``: owned segments whose lower end is not the parent end of any link.
    """
    tops = links.select(*image, F.col("child_x").alias("lower_x"), F.col("child_y").alias("lower_y")).distinct().withColumn("_top", F.lit(1))
    ends = links.select(*image, F.col("parent_x").alias("lower_x"), F.col("parent_y").alias("lower_y")).distinct().withColumn("_end", F.lit(1))
    on = [*image, "lower_x", "lower_y"]
    return owned_segments.join(tops, on, "left").join(ends, on, "left").groupBy(*image, plant).agg(
        F.count_if(F.col("_top").isNull()).alias("root_count"), F.count_if(F.col("_end").isNull()).alias("tip_count")
    )
