"""Thinning and local width of foreground pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.operators.pixels import RING, dilate, neighbourhood
from phenoframe.operators.spatial import nearest
from phenoframe.runtime import cut

N, NE, E, SE, S, SW, W, NW = (bit for _, _, bit in RING)


def _has(bit: int) -> Column:
    return F.col("ring").bitwiseAND(F.lit(bit)) != 0


def _removable(first: bool) -> Column:
    """Deletion test of one subpass on the neighbour bit mask (Zhang and Suen, 1984)."""
    circle = [N, NE, E, SE, S, SW, W, NW]
    rises = sum(
        (F.when(~_has(a) & _has(b), 1).otherwise(0) for a, b in zip(circle, circle[1:] + circle[:1])), F.lit(0)
    )
    sides = ((N, E, S), (E, S, W)) if first else ((N, E, W), (N, S, W))
    free = F.lit(True)
    for trio in sides:
        free = free & ~(_has(trio[0]) & _has(trio[1]) & _has(trio[2]))
    return F.col("degree").between(2, 6) & (rises == 1) & free


def thin(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-pixel skeleton of all images at once.

    Both subpasses need only the bit mask of the eight neighbours, one aggregation each. The
    number of rounds is about half the widest stroke. A pixel that can no longer change keeps
    being counted, because its neighbours still need it.
    """
    current = cut(px.select(*keys, "x", "y").distinct(), "thin")
    size = current.count()
    while True:
        for first in (True, False):
            current = neighbourhood(current, keys).where(~_removable(first)).select(*keys, "x", "y")
        current = cut(current, "thin")
        left = current.count()
        if left == size:
            return current
        size = left


def widths(points: DataFrame, foreground: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """(keys, x, y, width): twice the distance from each point to the nearest background pixel.

    Only background pixels next to the foreground can be nearest.
    """
    fg = foreground.select(*keys, "x", "y").distinct()
    border = dilate(fg, keys, 1, width, height).join(fg, [*keys, "x", "y"], "left_anti")
    found = nearest(points, border, keys)
    return found.select(*keys, "x", "y", (2.0 * F.sqrt("d2")).alias("width"))
