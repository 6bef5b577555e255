"""Labelled regions: filter by size and boundary, bounds of a plate, top edge of stems, first occurrences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def region_sizes(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, label, area, boundary, enclosed, min_x, max_x, min_y, max_y) of labelled pixels.

    ``boundary`` counts the pixels of which one of the four neighbours is not in the region; ``enclosed`` is the area
    of the polygon through pixel centres: one for each square of four neighbouring pixels, a half for each of three, so a
    line encloses nothing. Holes are not filled.
    """
    keys = list(keys)
    px = labelled.select(*keys, "label", "x", "y").distinct()
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    # Every pixel tells itself and its neighbours that it is there: one aggregation instead of four joins.
    told = px.withColumn("_o", F.explode(steps)).groupBy(
        *keys, "label", (F.col("x") + F.col("_o.i")).alias("x"), (F.col("y") + F.col("_o.j")).alias("y")).agg(
        F.count(F.lit(1)).alias("_n"), F.max((F.col("_o.i") == 0) & (F.col("_o.j") == 0)).alias("_own")).where("_own")
    sizes = told.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("area"), F.count_if(F.col("_n") < 5).alias("boundary"), F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    squares = px.withColumn("_o", F.explode(corners)).groupBy(*keys, "label", (F.col("x") + F.col("_o.i")).alias("x"), (F.col("y") + F.col("_o.j")).alias("y")).agg(
        F.count(F.lit(1)).alias("_n")).groupBy(*keys, "label").agg(
        F.sum(F.when(F.col("_n") == 4, 1.0).when(F.col("_n") == 3, 0.5).otherwise(0.0)).alias("enclosed"))
    return sizes.join(squares, [*keys, "label"]).select(*keys, "label", "area", "boundary", "enclosed", "min_x", "max_x", "min_y", "max_y")


def region_filter(labelled: DataFrame, keys: Sequence[str], min_boundary: int, min_area: float) -> DataFrame:
    """:func:`region_sizes` with ``reason``: null for regions that pass, else what they are too small in."""
    reason = F.when(F.col("boundary") <= min_boundary, "boundary").when(F.col("enclosed") <= min_area, "area")
    return region_sizes(labelled, keys).withColumn("reason", reason)


def top_edge(regions: DataFrame, images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, top): highest row of the regions that passed; 0 for images without any."""
    found = regions.where("reason is null").groupBy(*keys).agg(F.min("min_y").alias("top"))
    return images.select(*keys).distinct().join(found, list(keys), "left").na.fill(0, ["top"])


def plate_bounds(regions: DataFrame, images: DataFrame, keys: Sequence[str], union: bool = False, min_area: float = 100.0) -> DataFrame:
    """(keys, x, y, width, height) of the plate: the region that encloses most, or the union of all.

    Only regions that enclose more than ``min_area`` count; images without any keep their whole size. ``images`` has
    keys, width and height. Equal regions are told apart by their label.
    """
    keys = list(keys)
    large = regions.where(F.col("enclosed") > min_area)
    if union:
        box = large.groupBy(*keys).agg(*[f(c).alias(c) for f, c in ((F.min, "min_x"), (F.max, "max_x"), (F.min, "min_y"), (F.max, "max_y"))])
    else:
        order = F.struct("enclosed", (-F.col("label")).alias("_l"))
        box = large.groupBy(*keys).agg(F.max_by(F.struct("min_x", "max_x", "min_y", "max_y"), order).alias("_b")).select(*keys, "_b.*")
    joined = images.select(*keys, "width", "height").join(box, keys, "left")

    def span(low: str, high: str, whole: str) -> Column:
        return F.coalesce(F.col(high) - F.col(low) + 1, F.col(whole))

    return joined.select(
        *keys, F.coalesce("min_x", F.lit(0)).alias("x"), F.coalesce("min_y", F.lit(0)).alias("y"),
        span("min_x", "max_x", "width").alias("width"), span("min_y", "max_y", "height").alias("height"))


def first_occurrences(rows: DataFrame, of: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each combination of ``of``: the first in ``order``, which should be total.

    Rows are reduced before they are shuffled, so a combination that most rows repeat is no hot group.
    """
    rest = [c for c in rows.columns if c not in of]
    kept = rows.groupBy(*of).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return kept.select(*of, "_r.*").select(*rows.columns)
