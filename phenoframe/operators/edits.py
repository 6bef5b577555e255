"""Corrections: reassigned axes, masks and pixel ownership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from phenoframe.operators.ordered import ordered_columns
from phenoframe.runtime import cut


def axis_paths(axes: DataFrame, doc: Sequence[str], index: str, parent: str) -> DataFrame:
    """(doc, index, path): axis indices from the top axis down to each axis.

    Pointer doubling: each round joins the path of the current ancestor, so a chain of n axes takes
    about log2(n) joins. Parents that form a circle are refused.
    """
    rows = cut(axes.select(*doc, index, F.col(parent).alias("_up"), F.array(F.col(index)).alias("path")), "paths")
    reach = 1
    while not rows.where("_up is not null").isEmpty():
        if reach > 256 and reach > 2 * rows.count():
            raise ValueError("an axis is its own ancestor")
        above = rows.select(*doc, F.col(index).alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_head"))
        longer = rows.join(above, [*doc, "_up"], "left").select(
            *doc, index, F.col("_next").alias("_up"),
            F.when(F.col("_head").isNotNull(), F.concat("_head", "path")).otherwise(F.col("path")).alias("path"),
        )
        rows = cut(longer, "paths")
        reach *= 2
    return rows.select(*doc, index, "path")


def reassign_axes(
    axes: DataFrame, edits: DataFrame, doc: Sequence[str], index: str, parent: str, plant: str,
) -> DataFrame:
    """Move or delete chosen axes; orphans become primary axes of their own plant.

    ``edits`` has (doc, index, target); a null target deletes. The result is renumbered depth
    first; ``source_index`` keeps the old number.
    """
    marks = edits.select(*doc, index, F.lit(True).alias("_edit"), F.col("target").alias("_target"))
    moved = axes.join(marks, [*doc, index], "left").where("_edit is null or _target is not null")
    moved = moved.withColumn("_plant", F.coalesce("_target", plant))
    homes = moved.select(*doc, F.col(index).alias(parent), F.col("_plant").alias("_parent_plant"))
    linked = moved.join(homes, [*doc, parent], "left").withColumn(
        "_kept_parent", F.when(F.col("_parent_plant") == F.col("_plant"), F.col(parent))
    ).withColumn(parent, F.col("_kept_parent"))
    ordered = linked.join(axis_paths(linked, doc, index, parent), [*doc, index])
    numbered = ordered_columns(ordered, doc, ["_plant", "path"], number="_new")
    fresh = numbered.select(*doc, F.col(index).alias(parent), (F.col("_new") - 1).alias("_new_parent"))
    out = numbered.join(fresh, [*doc, parent], "left")
    rest = [c for c in axes.columns if c not in (*doc, index, parent, plant)]
    return out.select(
        *doc, (F.col("_new") - 1).alias(index), F.col("_new_parent").alias(parent), F.col("_plant").alias(plant),
        F.col(index).alias("source_index"), *rest,
    )


def mask_from_edits(edits: DataFrame, group: Sequence[str], seq: str, width: int, height: int) -> DataFrame:
    """Pixels set after replaying rectangle and stroke edits; the latest edit of a pixel wins.

    ``edits`` has shape ('rectangle' or 'stroke'), x0, y0, x1, y1, size (brush diameter), erase.
    """
    half = F.when(F.col("shape") == "stroke", F.greatest(F.col("size"), F.lit(1)) / 2.0).otherwise(F.lit(0.0))
    reach = F.floor(half).cast("int")

    def span(a, b, limit):
        return F.sequence(
            F.greatest(F.lit(0), F.least(F.col(a), F.col(b)) - reach),
            F.least(F.lit(limit - 1), F.greatest(F.col(a), F.col(b)) + reach),
        )

    visible = (
        (F.greatest("x0", "x1") + reach >= 0) & (F.least("x0", "x1") - reach < width)
        & (F.greatest("y0", "y1") + reach >= 0) & (F.least("y0", "y1") - reach < height)
    )
    px = (
        edits.withColumn("_half", half).where(visible)
        .withColumn("x", F.explode(span("x0", "x1", width)))
        .withColumn("y", F.explode(span("y0", "y1", height)))
    )
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    along = F.coalesce(
        F.try_divide((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy, (dx * dx + dy * dy).cast("double")),
        F.lit(0.0),
    )
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))
    distance = F.hypot(F.col("x") - F.col("x0") - t * dx, F.col("y") - F.col("y0") - t * dy)
    covered = (F.col("shape") == "rectangle") | (distance <= F.col("_half"))
    return (
        px.where(covered).groupBy(*group, "x", "y").agg(F.max_by("erase", F.col(seq)).alias("_erase"))
        .where("not _erase").select(*group, "x", "y")
    )


def pending_groups(working: DataFrame, applied: DataFrame, group: Sequence[str]) -> DataFrame:
    """Groups whose working mask differs from the applied mask."""
    left = working.select(*group, "x", "y").distinct().withColumn("_w", F.lit(1))
    right = applied.select(*group, "x", "y").distinct().withColumn("_a", F.lit(1))
    return left.join(right, [*group, "x", "y"], "full_outer").where("_w is null or _a is null").select(*group).distinct()


def edit_owned_pixels(
    owned: DataFrame, visible: DataFrame, keys: Sequence[str], owner: str, axis: str, edits: DataFrame
) -> DataFrame:
    """Apply axis edits to pixel ownership while masked pixels keep their owner.

    ``visible`` (keys, owner, axis, x, y) replaces the ownership of every pixel it shows.
    ``edits`` (keys, axis, target) moves or, with a null target, deletes whole axes; a pixel
    also used by an unedited axis of the same owner stays with it.
    """
    place = [*keys, "x", "y"]
    hidden = owned.join(visible.select(*place).distinct(), place, "left_anti").select(*place, owner)
    marked = visible.join(edits.select(*keys, axis, F.lit(True).alias("_edit"), "target"), [*keys, axis], "left")
    kept = marked.where("_edit is null").select(*place, owner)
    moved = marked.where("_edit and target is not null").select(*place, F.col("target").alias(owner))
    return hidden.unionByName(kept).unionByName(moved).distinct()


def move_origin(stems: DataFrame, moves: DataFrame, group: Sequence[str], overridden: str) -> DataFrame:
    """Set a slot's origin in every frame of its group that is not overridden."""
    new = moves.select(*group, "slot", F.col("x").alias("_x"), F.col("y").alias("_y"))
    joined = stems.join(new, [*group, "slot"], "left")
    return joined.select(
        *[
            F.when(~F.col(overridden), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in ("x", "y") else F.col(c)
            for c in stems.columns
        ]
    )


def masked_axes(
    pieces: DataFrame, axes: DataFrame, doc: Sequence[str], index: str, parent: str
) -> DataFrame:
    """One row per visible piece with its source axis and parent piece.

    A piece hangs below the first visible piece of its parent axis; when no piece of the parent
    is visible the piece becomes primary.
    """
    seen = pieces.select(*doc, index, "piece").distinct()
    count = seen.groupBy(*doc, index).agg(F.count(F.lit(1)).alias("n_pieces"), F.min("piece").alias("_first"))
    above = count.select(*doc, F.col(index).alias(parent), F.col("_first").alias("parent_piece"))
    named = seen.join(count.drop("_first"), [*doc, index]).join(axes.select(*doc, index, parent), [*doc, index])
    return named.join(above, [*doc, parent], "left").select(
        *doc, F.col(index).alias("source_index"), "piece", "n_pieces",
        F.when(F.col("parent_piece").isNotNull(), F.col(parent)).alias("parent_source"), "parent_piece",
    )
