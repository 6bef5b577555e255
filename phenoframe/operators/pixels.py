"""Sparse pixel tables: one row per set pixel, keyed by image columns plus integer x, y.

Every operator works on exact (image, x, y) keys, so one image holding most of the pixels
still spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The eight neighbours with their bit in a neighbourhood mask, clockwise from north.
RING = [(0, -1, 1), (1, -1, 2), (1, 0, 4), (1, 1, 8), (0, 1, 16), (-1, 1, 32), (-1, 0, 64), (-1, -1, 128)]


def _offsets(column: str, n: int) -> Column:
    return F.explode(F.sequence(F.col(column) - n, F.col(column) + n))


def _clip(df: DataFrame, width, height) -> DataFrame:
    if width is not None:
        df = df.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    return df


def dilate(px: DataFrame, keys: Sequence[str], n: int = 1, width: int | None = None, height: int | None = None) -> DataFrame:
    """Grow by n pixels in all eight directions: a row pass, then a column pass."""
    rows = px.select(*keys, _offsets("x", n).alias("x"), "y").distinct()
    grown = rows.select(*keys, "x", _offsets("y", n).alias("y")).distinct()
    return _clip(grown, width, height)


def erode(px: DataFrame, keys: Sequence[str], n: int = 1, width: int | None = None, height: int | None = None) -> DataFrame:
    """Keep pixels whose whole surrounding is set; positions outside the image do not count."""
    def span(column, size):
        if size is None:
            return F.lit(2 * n + 1)
        return F.least(F.col(column) + n, F.lit(size - 1)) - F.greatest(F.col(column) - n, F.lit(0)) + 1

    px = px.select(*keys, "x", "y").distinct()
    rows = (
        px.select(*keys, _offsets("x", n).alias("x"), "y")
        .groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == span("x", width))
    )
    kept = (
        rows.select(*keys, "x", _offsets("y", n).alias("y"))
        .groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == span("y", height))
    )
    return _clip(kept.drop("_n"), width, height)


def neighbourhood(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each pixel with its 8-neighbour count and bit mask, in one shuffle.

    Every pixel announces itself to its neighbours; positions that were only announced to but
    hold no pixel are dropped after the aggregation.
    """
    here = F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit(0).alias("bit"))
    ring = [F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), F.lit(bit).alias("bit")) for dx, dy, bit in RING]
    told = px.select(*keys, "x", "y", F.explode(F.array(here, *ring)).alias("o")).select(
        *keys, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), F.col("o.bit").alias("bit")
    )
    return (
        told.groupBy(*keys, "x", "y")
        .agg(F.bit_or("bit").alias("ring"), F.bool_or(F.col("bit") == 0).alias("_set"))
        .where("_set")
        .select(*keys, "x", "y", F.bit_count("ring").alias("degree"), "ring")
    )


def line_ends(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    return neighbourhood(px, keys).where("degree = 1").select(*keys, "x", "y")


def branch_points(px: DataFrame, keys: Sequence[str], grow: int = 1) -> DataFrame:
    """Pixels with at least three neighbours, widened by ``grow``."""
    centres = neighbourhood(px, keys).where("degree >= 3").select(*keys, "x", "y")
    return dilate(centres, keys, grow) if grow else centres


def frame_difference(px: DataFrame, group: Sequence[str], frame: str, value: str) -> DataFrame:
    """Value minus the previous frame's value at the same place, never below zero."""
    before = px.select(*group, (F.col(frame) + 1).alias(frame), "x", "y", F.col(value).alias("_before"))
    joined = px.join(before, [*group, frame, "x", "y"], "left")
    return joined.select(
        *group, frame, "x", "y", F.greatest(F.col(value) - F.coalesce("_before", F.lit(0)), F.lit(0)).alias("gain")
    )


def exclude(px: DataFrame, mask: DataFrame, group: Sequence[str]) -> DataFrame:
    """Drop masked pixels. A mask of another size than its image is ignored.

    Both sides carry ``width`` and ``height``.
    """
    marks = mask.select(*group, "width", "height", "x", "y")
    return px.join(marks, [*group, "width", "height", "x", "y"], "left_anti")


def clear_margins(px: DataFrame, width: int, height: int, top: float, bottom: float, left: float, right: float) -> DataFrame:
    t, b = round(top * height), round(bottom * height)
    l, r = round(left * width), round(right * width)
    return px.where(F.col("x").between(l, width - 1 - r) & F.col("y").between(t, height - 1 - b))


def in_every_frame(px: DataFrame, keys: Sequence[str], frame: str, frames: DataFrame, group: Sequence[str]) -> DataFrame:
    """Keys seen in all frames of their group (relational division)."""
    total = frames.groupBy(*group).agg(F.count_distinct(frame).alias("_need"))
    seen = px.select(*keys, frame).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_seen"))
    return seen.join(total, list(group)).where("_seen = _need").select(*keys)


def clear_above_stems(px: DataFrame, stems: DataFrame, keys: Sequence[str], width: Column) -> DataFrame:
    """Remove pixels above a stem in the columns [x - width/12, x + width/12), last column kept.

    A band condition cannot be hashed, so stems are expanded to the columns they cover and
    reduced to the lowest stem per column; the join is then on exact columns.
    """
    half = F.floor(width / 12.0).cast("int")
    first = F.greatest(F.col("x") - half, F.lit(0))
    last = F.least(F.col("x") + half, width - 1) - 1
    bands = (
        stems.select(*keys, first.alias("_first"), last.cast("int").alias("_last"), F.col("y").alias("_sy"))
        .where("_last >= _first")
        .select(*keys, "_sy", F.explode(F.sequence("_first", "_last")).alias("x"))
        .groupBy(*keys, "x").agg(F.max("_sy").alias("_limit"))
    )
    return px.join(bands, [*keys, "x"], "left").where("_limit is null or y >= _limit").drop("_limit")
