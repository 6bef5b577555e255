"""Rejection of stationary, disconnected objects over a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from phenoframe.operators.components import label_pixels
from phenoframe.operators.pixels import dilate
from phenoframe.operators.spatial import nearest
from phenoframe.runtime import cut


def protected_labels(labels: DataFrame, union: DataFrame, origins: DataFrame, group: Sequence[str]) -> DataFrame:
    """Labels at a stem, first straight below it, and nearest below it.

    A group has a few stems, so each pixel meets only those; the minimum is taken before any
    shuffle of the pixels.
    """
    stems = origins.select(*group, F.col("x").alias("_sx"), F.col("y").alias("_sy")).distinct()
    at = labels.join(stems.select(*group, F.col("_sx").alias("x"), F.col("_sy").alias("y")), [*group, "x", "y"], "left_semi")
    below = union.join(stems, list(group)).where("y >= _sy")
    d2 = (F.col("x") - F.col("_sx")) * (F.col("x") - F.col("_sx")) + (F.col("y") - F.col("_sy")) * (F.col("y") - F.col("_sy"))
    found = below.groupBy(*group, "_sx", "_sy").agg(
        F.min(F.struct(d2.alias("d2"), F.col("y"), F.col("x"))).alias("_near"),
        F.min(F.when(F.col("x") == F.col("_sx"), F.col("y"))).alias("_direct"),
    )
    spots = found.select(*group, F.col("_near.x").alias("x"), F.col("_near.y").alias("y")).unionByName(
        found.where("_direct is not null").select(*group, F.col("_sx").alias("x"), F.col("_direct").alias("y"))
    )
    return at.select(*group, "label").unionByName(
        labels.join(spots, [*group, "x", "y"], "left_semi").select(*group, "label")
    ).distinct()


def static_labels(
    fg: DataFrame, origins: DataFrame, frames: DataFrame, group: Sequence[str], frame: str, extent: int
) -> tuple[DataFrame, DataFrame]:
    """(rejected labels, labelled foreground) of all groups.

    ``frames`` has (group, frame, usable). Groups with an unusable frame, or with fewer than two
    frames, reject nothing.
    """
    group = list(group)
    judged = frames.groupBy(*group).agg(
        F.bool_and("usable").alias("_ok"), F.count_distinct(frame).alias("_frames"), F.min(frame).alias("_first")
    ).where("_ok and _frames >= 2").drop("_ok")
    fg = cut(fg.select(*group, frame, "x", "y").distinct().join(judged.select(*group), group, "left_semi"), "static")
    union = fg.select(*group, "x", "y").distinct()
    labels = cut(label_pixels(dilate(union, group, 1, extent, extent), group), "labels")
    labelled = cut(fg.join(labels, [*group, "x", "y"]), "labelled")
    guarded = protected_labels(labels, union, origins, group)

    seen = labelled.groupBy(*group, "label", frame).agg(F.min("x").alias("_mx"), F.min("y").alias("_my"))
    everywhere = (
        seen.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("_n")).join(judged, group).where("_n = _frames")
        .select(*group, "label", "_first").join(guarded, [*group, "label"], "left_anti")
    )
    persistent = cut(everywhere, "persistent")
    here = labelled.join(persistent, [*group, "label"])
    # Equal silhouettes have equal counts and equal folds of their offsets.
    offset = F.xxhash64(F.col("x") - F.col("_mx"), F.col("y") - F.col("_my"))
    shapes = here.join(seen, [*group, "label", frame]).groupBy(*group, "label", frame, "_first", "_mx", "_my").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(offset).alias("_h1"),
        F.sum(F.hash(F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")).cast("long")).alias("_h2"),
    )
    start = shapes.where(F.col(frame) == F.col("_first")).select(
        *group, "label", "_n", "_h1", "_h2", F.col("_mx").alias("_x0"), F.col("_my").alias("_y0")
    )
    votes = shapes.join(start, [*group, "label", "_n", "_h1", "_h2"]).select(
        *group, frame, (F.col("_mx") - F.col("_x0")).alias("_dx"), (F.col("_my") - F.col("_y0")).alias("_dy")
    )
    shifts = votes.groupBy(*group, frame).agg(
        F.count(F.lit(1)).alias("_votes"), F.bround(F.percentile("_dx", F.lit(0.5))).cast("int").alias("_dx"),
        F.bround(F.percentile("_dy", F.lit(0.5))).cast("int").alias("_dy"),
    ).where("_votes >= 3").drop("_votes")

    keys = [*group, "label"]
    pad = extent
    first = cut(
        here.where(F.col(frame) == F.col("_first")).select(*keys, (F.col("x") + pad).alias("x"), (F.col("y") + pad).alias("y")), "first"
    )
    border = dilate(first, keys, 1).join(first, [*keys, "x", "y"], "left_anti")
    radius = nearest(first, border, keys).groupBy(*keys).agg(F.max("d2").alias("_r2"))
    later = here.where(F.col(frame) > F.col("_first")).join(shifts, [*group, frame], "left").select(
        *keys, (F.col("x") - F.coalesce("_dx", F.lit(0)) + pad).alias("x"), (F.col("y") - F.coalesce("_dy", F.lit(0)) + pad).alias("y")
    ).distinct()
    outside = later.join(first, [*keys, "x", "y"], "left_anti")
    grown = nearest(outside, first, keys).join(radius, keys).where("d2 > _r2").select(*keys).distinct()
    return persistent.select(*keys).join(grown, keys, "left_anti"), labelled


def drop_static(
    fg: DataFrame, origins: DataFrame, frames: DataFrame, group: Sequence[str], frame: str, extent: int
) -> DataFrame:
    """Foreground without stationary, disconnected objects."""
    rejected, labelled = static_labels(fg, origins, frames, group, frame, extent)
    removed = labelled.join(rejected, [*group, "label"], "left_semi").select(*group, frame, "x", "y")
    return fg.join(removed, [*group, frame, "x", "y"], "left_anti")
